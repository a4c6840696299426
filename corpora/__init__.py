"""Essay-corpus studies on Spark: prepare, split, compare and score text corpora."""
