"""vigil.streaming"""
