"""Media-signal analytics expressed as Spark DataFrame operators."""
