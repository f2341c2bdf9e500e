"""Correspondence analytics on PySpark."""
