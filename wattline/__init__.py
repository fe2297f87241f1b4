"""Spark operators for finding anomalies in sensor readings held by several clients."""
