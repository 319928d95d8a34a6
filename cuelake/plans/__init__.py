"""cuelake.plans"""
