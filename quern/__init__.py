"""quern: a Spark-native engine for document ingestion and hybrid retrieval."""
