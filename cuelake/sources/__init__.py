"""cuelake.sources"""
