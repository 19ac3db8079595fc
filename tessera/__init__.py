"""tessera: a Spark-native analytics engine for spoken-word and long-form text."""
