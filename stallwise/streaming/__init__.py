"""Structured Streaming jobs: the counters kept up to date as page views arrive."""
