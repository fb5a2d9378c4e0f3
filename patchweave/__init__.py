"""patchweave: Spark-native analytics over large collections of small items (glyph patches, texts, vectors)."""
