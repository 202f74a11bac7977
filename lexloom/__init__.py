"""lexloom: a Spark-native engine for legal corpora and training-data preparation."""
