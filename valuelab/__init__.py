"""Order-value analytics on Spark DataFrames.

Profiling, cleaning, feature, distribution, split / imputation, plot-data and
model operators for booking-style tables.  Every operator takes a DataFrame and
column names and returns a DataFrame (or, for the ``fit_*`` functions, a small
rule object whose ``apply`` is a narrow projection).
"""
