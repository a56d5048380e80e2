"""Training-data operators for large text corpora; each module holds one, built by one published method."""
