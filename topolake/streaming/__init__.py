"""streaming of the engine"""
