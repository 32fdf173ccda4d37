"""Training-corpus operators: archives, language and quality scores, packing, near-duplicates, shards, mixing, extraction, search."""
