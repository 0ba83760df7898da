"""operators of the engine"""
