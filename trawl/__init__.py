"""A Spark-native engine for filtered, hybrid top-k retrieval and for preparing training data."""
