"""Tessera: a Spark-first engine for data quality, log incidents, record transformation and document fields."""
