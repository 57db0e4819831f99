"""fieldloom: a PySpark-native engine for pixel, segment, tile and instance analytics."""
