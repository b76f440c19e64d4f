"""Tree-sequence analytics on Spark."""
