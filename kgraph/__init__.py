"""Typed property graphs over source repositories, as PySpark DataFrames."""
