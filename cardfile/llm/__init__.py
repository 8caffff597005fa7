"""Training-data operators: DataFrames in, DataFrames out.

Nothing outside this subpackage imports it. Each module holds one operator
with its general interface; `queries` derives the registered results.
"""
