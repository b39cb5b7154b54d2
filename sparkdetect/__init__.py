"""Measure detection rules on event tables with Spark DataFrames."""
