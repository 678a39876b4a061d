"""Keyed reconciliation of two datasets, written as Spark DataFrame jobs."""
