"""Media-library analytics as Spark DataFrame operators."""
