"""talus.operators"""
