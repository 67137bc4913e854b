"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator takes DataFrames and
returns DataFrames; ``queries.py`` holds the thin contract queries and ``sql.py`` their SQL.
"""
