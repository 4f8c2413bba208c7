"""vigil.functions"""
