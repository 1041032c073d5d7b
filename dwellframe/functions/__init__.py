"""Column functions: every one is a plain Spark expression, no Python UDFs."""
