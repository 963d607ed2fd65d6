"""Training-data operators: tokenised output, quality, extraction, deduplication,
packing and personal data. Nothing outside this subpackage imports it."""
