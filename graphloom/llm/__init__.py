"""Operators for preparing text corpora for model training, each a Spark job over whole tables."""
