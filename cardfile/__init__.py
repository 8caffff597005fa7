"""Contact-data analytics on Spark."""
