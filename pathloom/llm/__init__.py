"""Operators for preparing training data: extraction, scoring, tokenising, joins, dedup and mixing.

Nothing outside this folder imports it.  Every operator is a function from DataFrames to
DataFrames; ``queries.py`` holds the thin registered queries and their SQL.
"""
