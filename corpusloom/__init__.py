"""corpusloom: a Spark-native document index, hybrid search and corpus-processing engine."""

__version__ = "0.1.0"
