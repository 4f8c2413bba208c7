"""vigil.plans"""
