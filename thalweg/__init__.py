"""Thalweg: climate time series, gridded fields and corpus analytics on PySpark."""
