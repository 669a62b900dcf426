"""Training-data operators: quality, toxicity, near-duplicates, archives, tokens, languages,
repeated passages, secrets, vector search and source mixing. Nothing outside this folder imports it."""
