"""quarry: a Spark-native engine for retrieving ranked, bounded context from large corpora."""
