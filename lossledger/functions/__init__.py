"""Column functions: plain `Column -> Column` helpers over built-in Spark expressions."""
