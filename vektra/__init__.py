"""Vector search, hybrid retrieval and collection operators as Spark DataFrame plans."""
