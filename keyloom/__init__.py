"""keyloom: Spark-native analytics over versioned, replicated key-value data."""

__version__ = "0.1.0"
