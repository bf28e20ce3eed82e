"""Network-flow analytics expressed as Spark DataFrame transformations."""
