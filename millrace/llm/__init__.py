"""Operators for large training corpora. ``registry`` holds their queries and SQL."""
