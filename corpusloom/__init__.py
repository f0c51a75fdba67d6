"""corpusloom: a Spark-native engine for searching, ranking and relating a corpus of texts."""
