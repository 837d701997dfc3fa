"""gridwright: a Spark-native engine for messy tabular inputs and their quality evidence."""

__version__ = "0.1.0"
