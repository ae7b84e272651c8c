"""Operators for large training-data corpora and their queries.

Nothing else in the library imports this package.  Every operator takes DataFrames and returns DataFrames; the queries over
the test tables are in ``queries``.
"""
