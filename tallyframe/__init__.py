"""Entity-event analytics expressed as Spark DataFrame operators."""
