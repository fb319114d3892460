"""lexmill: text search, ranking and corpus analytics expressed as Spark DataFrame plans."""
