"""plans of the engine"""
