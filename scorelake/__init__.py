"""Evaluation analytics on Spark: planning, text features, scoring and summaries."""
