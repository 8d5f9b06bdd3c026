"""Operators that prepare training corpora: search, sharding, mixing, extraction, archives, near-duplicates, licences, tokens, quality and toxicity."""
