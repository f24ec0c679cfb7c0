"""Column functions: text cleaning, fingerprints, vectors, lexical terms."""
