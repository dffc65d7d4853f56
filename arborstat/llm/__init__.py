"""Training-data operators: filtering, deduplication, tokenising, packing and storage.

Nothing outside this subpackage imports it. Each module is one operator with a general
interface; `queries` holds the thin registered queries and `sql` their SQL.
"""
