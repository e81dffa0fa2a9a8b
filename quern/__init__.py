"""Automated tabular data preparation and exploratory statistics on Spark."""
