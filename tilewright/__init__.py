"""Cohort, tile and embedding analytics as lazy Spark SQL plans."""
