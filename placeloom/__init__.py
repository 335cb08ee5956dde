"""Spark-first analytics engine for place and venue data."""
