"""Resampling and sample-size analytics on PySpark DataFrames."""
