"""folioscope: Spark-native analysis of recognised document text."""
