"""Placement analytics on Spark."""
