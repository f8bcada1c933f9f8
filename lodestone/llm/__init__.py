"""Operators for preparing large text corpora.

Nothing else in ``lodestone`` imports this subpackage.  Every operator takes
DataFrames, reads only the columns it names, and returns a DataFrame.
"""
