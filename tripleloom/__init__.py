"""tripleloom: building knowledge graphs from text with Spark DataFrames."""
