"""Point-in-time event analytics on Spark."""
