"""tessella: a PySpark-native engine for paired-evaluation and corpus analytics."""
