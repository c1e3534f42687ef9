"""lodestone: Spark-native preparation, scoring and sampling estimation over text and code corpora."""
