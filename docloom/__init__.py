"""A Spark-native engine for collections of documents: index, search, tags, duplicates, refresh."""
