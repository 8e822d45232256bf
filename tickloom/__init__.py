"""tickloom: panel market data and market text as plain Spark DataFrame functions."""
