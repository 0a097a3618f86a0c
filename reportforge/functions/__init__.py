"""reportforge.functions"""
