"""sources of the engine"""
