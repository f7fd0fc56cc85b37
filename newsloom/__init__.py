"""News-event analytics as Spark DataFrame operators."""
