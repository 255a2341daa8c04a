"""Catchment analytics as Spark DataFrame jobs."""
