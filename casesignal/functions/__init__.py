"""Column expressions. Nothing here starts a Spark job."""
