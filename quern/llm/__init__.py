"""Training-data operators: filtering, fingerprints, packing, extraction and tokenisation."""
