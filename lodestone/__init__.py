"""A Spark-first engine for grounded retrieval over documents, and its evaluation."""
