"""Crowd-attention analytics on Spark: posts to daily counts, sentiment, signals and their evaluation."""
