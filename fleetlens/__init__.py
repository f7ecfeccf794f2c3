"""Endpoint-telemetry analytics on Spark DataFrames.

Every operator takes DataFrames and returns a lazy DataFrame. Nothing is collected, and no
operator loops over alerts: the alert name travels as the grouping column ``sensor``.
"""
