"""quarry: corpus search, ingest and analytics expressed as Spark DataFrame plans."""
