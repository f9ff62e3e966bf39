"""Catalogue integration and analytics on Spark: plain DataFrame -> DataFrame functions."""
