"""reportforge.streaming"""
