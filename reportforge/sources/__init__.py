"""reportforge.sources"""
