"""A PySpark-native engine that turns captures of web pages into ranked, explained change records."""
