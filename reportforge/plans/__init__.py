"""reportforge.plans"""
