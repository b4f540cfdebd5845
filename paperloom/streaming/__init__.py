"""Streaming views of jobs."""
