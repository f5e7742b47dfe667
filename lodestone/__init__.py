"""lodestone: a PySpark-native query and analytics engine."""

__version__ = "0.1.0"
