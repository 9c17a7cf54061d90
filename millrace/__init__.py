"""Millrace: a Spark engine for building and measuring instruction-tuning corpora."""
