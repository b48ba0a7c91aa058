"""Tabular analytics on Spark: roles, profiles, quality, cleaning, aggregates, drift, features.

Every operator takes a DataFrame and returns a DataFrame.  What a job needs to know about a table
before it can be planned (row counts, per-column statistics, quantile fences) is read by the driver
as one row per column; data rows never are.
"""
