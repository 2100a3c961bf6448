"""quillon: DataFrame-native retrieval and corpus processing on Spark."""
