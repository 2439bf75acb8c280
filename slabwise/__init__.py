"""slabwise: a Spark-native engine for scoring, curating and evaluating report corpora."""
