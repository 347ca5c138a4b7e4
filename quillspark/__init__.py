"""quillspark: a Spark-native engine for entity analytics, recommendation and corpus preparation."""
