"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it.  Every operator takes DataFrames and
returns DataFrames that carry their own key and result columns only, so extra
columns of the input, whatever their names, never clash with a result.
"""
