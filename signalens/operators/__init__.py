"""Relational operators: references, catalog checks, lint, suggestions, findings, metrics."""
