"""A PySpark-native engine for semantic facts: typed tables, navigation, change planning."""
