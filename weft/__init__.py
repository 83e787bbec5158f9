"""weft: a Spark-native analytics engine for document corpora and knowledge graphs."""
