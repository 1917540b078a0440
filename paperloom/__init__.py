"""paperloom: a PySpark-native document analytics engine."""
