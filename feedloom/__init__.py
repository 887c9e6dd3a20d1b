"""Feedloom: news and filing analytics as Spark DataFrames."""
