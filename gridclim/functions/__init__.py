"""Column expressions: native Spark SQL functions only."""
