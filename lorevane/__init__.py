"""lorevane: a Spark-native document ingestion and hybrid retrieval engine."""
