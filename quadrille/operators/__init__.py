"""Operators that join, group or iterate over DataFrames."""
