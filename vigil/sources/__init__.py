"""vigil.sources"""
