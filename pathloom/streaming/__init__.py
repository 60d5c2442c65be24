"""Structured Streaming over record files: exactly-once resume, late rows, running quotas."""
