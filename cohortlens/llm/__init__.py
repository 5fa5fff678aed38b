"""Training-data operators: deduplication, quality, tokens, secrets, URLs, decontamination."""
