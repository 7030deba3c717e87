"""Column-level building blocks: hashing, cleaning, encoding, dates, and tail probabilities."""
