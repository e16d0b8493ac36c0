"""Continuous validation."""
