"""A Spark-native engine for cleaning and restructuring text at scale."""
