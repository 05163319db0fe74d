"""cairn.sources"""
