"""Training-data operators: deduplication, scans, quality, mixing and language-model scoring."""
