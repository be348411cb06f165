"""Frontier-gap analytics on Spark: how far one group of scored, dated records trails another."""
