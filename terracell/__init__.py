"""terracell: a Spark-native engine for cell-based spatial data and the statistics and models on it."""
