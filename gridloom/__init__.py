"""Building-energy meter analytics written for Spark.

Every operator takes DataFrames and returns a DataFrame; column names are
arguments, so the same function serves any table with the right shape.
"""
