"""newsloom: a Spark-native analytics engine for news and post streams."""
