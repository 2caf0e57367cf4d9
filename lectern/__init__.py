"""lectern: a PySpark-native engine for document ingestion, chunking and conversation processing."""
