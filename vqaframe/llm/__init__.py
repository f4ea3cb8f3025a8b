"""Training-data operators: token counts, tokenizer transducer, repeated-passage, line and
near-duplicate removal, exact vector search, quality rules, packing, license scans, archive audit,
fill-in-middle, secret scans, periodic runs.

Nothing else in the library imports this subpackage. ``queries.py`` holds its registered queries,
``oracle.py`` the SQL for those that SQL can express.
"""
