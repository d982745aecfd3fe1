"""memloom: a Spark-native engine for conversational-memory analytics."""
