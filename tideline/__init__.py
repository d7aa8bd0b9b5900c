"""tideline: a PySpark-native engine for calendar-anchored event analytics."""
