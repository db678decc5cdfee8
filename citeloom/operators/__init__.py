"""Operators on the citation network: functions from DataFrames to DataFrames."""
