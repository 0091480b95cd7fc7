"""Endpoint telemetry analytics on Spark DataFrames."""
