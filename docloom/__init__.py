"""docloom: Spark-native processing of noisy document records."""
