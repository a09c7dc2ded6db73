"""cinelake: a Spark-native store and query engine for time-indexed media."""

__version__ = "0.1.0"
