"""Linked-data analytics on Spark."""
