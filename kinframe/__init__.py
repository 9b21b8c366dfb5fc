"""A Spark-native engine for near-duplicate media catalogs."""
