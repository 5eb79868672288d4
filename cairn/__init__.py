"""Batch jobs over hierarchical site, sample and measurement data on Spark."""
