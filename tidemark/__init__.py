"""tidemark: multi-version key-value analytics as ordinary Spark DataFrame programs."""
