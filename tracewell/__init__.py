"""Tracewell: provenance analytics and training-data preparation on Spark."""
