"""heronlake.functions"""
