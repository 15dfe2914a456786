"""Equity analytics on PySpark."""
