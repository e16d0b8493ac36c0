"""Scans: paths, rule files, dashboards, expressions, allowlists, catalogs."""
