"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; `queries` binds them to the tables of a data directory.
"""
