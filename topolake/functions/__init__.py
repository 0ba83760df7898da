"""functions of the engine"""
