"""talus.plans"""
