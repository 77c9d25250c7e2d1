"""Operators for large-scale training-data preparation.

Self-contained: nothing outside this subpackage imports it.  Every operator
takes a DataFrame and column names, selects only the columns it needs under
its own names (extra or clashing columns of the input do no harm) and returns
a DataFrame.
"""
