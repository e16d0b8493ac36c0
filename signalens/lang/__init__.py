"""Parsers of query languages, without Spark: an expression in, its structural references out."""
