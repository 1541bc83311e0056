"""Security-behaviour analytics as plain Spark DataFrame jobs."""
