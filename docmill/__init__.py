"""A Spark-native document indexing and retrieval engine."""
