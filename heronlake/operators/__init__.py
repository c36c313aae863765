"""heronlake.operators"""
