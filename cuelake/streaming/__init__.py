"""cuelake.streaming"""
