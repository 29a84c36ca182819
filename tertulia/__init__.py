"""Chat-history analytics as Spark DataFrame operators."""
