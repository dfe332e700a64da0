"""Threshold-risk analytics on hourly multi-series data, as Spark DataFrame operators."""
