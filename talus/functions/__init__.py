"""talus.functions"""
