"""Training-data operators: scans, filters, deduplication, extraction and tokenisation at corpus scale."""
