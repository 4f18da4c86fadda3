"""talus.sources"""
