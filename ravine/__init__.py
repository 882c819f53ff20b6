"""ravine: retrieval, ingestion and operational analytics over a columnar chunk table, on Spark."""
