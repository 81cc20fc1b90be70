"""stratalog: a Spark-native engine over a typed knowledge store."""
