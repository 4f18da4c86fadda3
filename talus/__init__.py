"""talus: Spark-native code, text and event analytics."""
