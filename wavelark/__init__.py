"""Value-change analytics on Spark."""
