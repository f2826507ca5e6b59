"""quernstone: a Spark-native retrieval, qualification and corpus-processing engine."""

__version__ = "0.1.0"
