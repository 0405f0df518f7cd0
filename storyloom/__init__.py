"""storyloom: a Spark-native engine for searching, reading and analysing versioned story corpora."""

__version__ = "0.1.0"
