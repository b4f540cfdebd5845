"""Conversion routes and their pipelines."""
