"""Retail card analytics on Spark."""
