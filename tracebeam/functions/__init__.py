"""Column functions: plain expressions over Spark columns."""
