"""heronlake.sources"""
