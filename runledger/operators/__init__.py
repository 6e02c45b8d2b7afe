"""Operators: functions from DataFrames and an ``as_of`` day to a DataFrame."""
