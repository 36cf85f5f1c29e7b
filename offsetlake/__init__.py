"""offsetlake: append-only tables fed from a partitioned, offset-addressed log, on Spark."""
