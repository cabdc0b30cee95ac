"""Storage-trace analytics on Spark."""
