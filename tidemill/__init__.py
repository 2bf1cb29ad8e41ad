"""Market time-series analytics as Spark DataFrame operators, keyed by instrument."""
