"""tabscope: Spark-native automated table analysis, features, models, retrieval and event logs."""

__version__ = "0.1.0"
