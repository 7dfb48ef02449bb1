"""Operators that prepare text for training language models.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries`` holds the thin registered queries on top of them.
"""
