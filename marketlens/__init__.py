"""Retail-marketplace analytics on PySpark."""
