"""heronlake.streaming"""
