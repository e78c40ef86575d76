"""A Spark-native engine for a small typed query language, table verbs and key/value views."""
