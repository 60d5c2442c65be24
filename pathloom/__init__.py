"""Layer-path analytics on Spark."""
