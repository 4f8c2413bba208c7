"""vigil.operators"""
