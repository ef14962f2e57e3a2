"""Spark-native raster, tile and log analytics, with operators for training corpora in `gridloom.llm`."""
