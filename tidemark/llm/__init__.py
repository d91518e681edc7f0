"""Training-data operators: deduplication, filtering, scans, scoring and mixing.

Every operator takes and returns DataFrames. Nothing else in the library
imports this subpackage.
"""
