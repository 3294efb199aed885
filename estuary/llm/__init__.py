"""Training-data operators: tokenisation, toxicity, fingerprints, packing, scoring, search, dedup, scans, audit, quality."""
