"""reportforge.operators"""
