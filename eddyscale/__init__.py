"""Cross-scale transfer analytics on Spark."""
