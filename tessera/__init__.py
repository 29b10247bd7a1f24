"""Cohort feature analytics on Spark."""
