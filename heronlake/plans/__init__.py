"""heronlake.plans"""
