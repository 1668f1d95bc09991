"""lakemill: a Spark-native engine for ingesting, scanning, repairing and compacting lake data."""

__version__ = "0.1.0"
