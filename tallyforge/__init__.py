"""Filings analytics as Spark DataFrame jobs.

Every operator takes and returns DataFrames.  Nothing in the package collects
table rows to the driver; the taxonomy, the ratio formulas and the red-flag
rules are data that the operators turn into column expressions.
"""
