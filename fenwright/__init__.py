"""fenwright: a PySpark-native engine that turns messy documents into validated tables."""

__version__ = "0.1.0"
