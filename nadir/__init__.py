"""Nadir: negative-evidence analytics on PySpark."""
