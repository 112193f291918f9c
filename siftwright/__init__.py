"""siftwright: a Spark-native code and document intelligence engine."""
