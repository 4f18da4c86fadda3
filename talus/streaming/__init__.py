"""talus.streaming"""
