"""Continuous forms of the jobs, on Structured Streaming."""
