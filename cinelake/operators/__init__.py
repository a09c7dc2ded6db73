"""Operators over the catalog and over frames: functions from DataFrames to DataFrames."""
