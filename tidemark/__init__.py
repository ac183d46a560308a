"""tidemark: a Spark-native engine for cleaning, deduplicating and verifying web corpora."""

__version__ = "0.1.0"
