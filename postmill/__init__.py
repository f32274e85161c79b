"""postmill: a Spark-native engine for message corpora (ingest, repair, dedup, cluster, split, score, audit)."""

__version__ = "0.2.0"
