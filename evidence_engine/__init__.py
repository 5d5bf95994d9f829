"""PySpark-native evidence retrieval and document analytics."""
