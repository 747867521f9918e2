"""Conversation processing on Spark: requests and turns as DataFrames."""
