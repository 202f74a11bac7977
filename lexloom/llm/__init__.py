"""Training-data operators: dedup, licences, extraction, sharding, quality, packing, search, mixing.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; `queries.py` binds them to the tables of a folder.
"""
