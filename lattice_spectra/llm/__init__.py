"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it. Each module holds one operator;
``queries`` holds the thin ``opN_*`` queries and ``oracles`` their SQL.
"""
