"""quern: a Spark-native analytics engine for incremental, marketplace-style records."""
