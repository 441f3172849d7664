"""Training-data operators: deduplication, tokenisation, packing, scans, media columns and quality.

Every operator takes and returns DataFrames.  ``queries.py`` holds the thin
``opN_*`` queries over the shared tables.  Nothing outside this folder imports it.
"""
