"""workpulse: a PySpark-native engine for work reports."""
