"""Streams: the studied operators have no windows, watermarks or state, so nothing of that kind is here.

Row-wise functions (functions.geometry, functions.text, sources.records.engine_rows, operators.validate.broken) take
streaming DataFrames as they are; the tests run one.
"""
