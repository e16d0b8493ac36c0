"""Whole plans: validation of a corpus, and reports."""
