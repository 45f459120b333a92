"""A Spark-native analytics engine for generated candidates, their scores and their texts."""

__version__ = "0.1.0"
