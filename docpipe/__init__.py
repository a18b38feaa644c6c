"""PySpark-native documentation and corpus analytics."""
