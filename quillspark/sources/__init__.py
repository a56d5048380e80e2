"""Readers (S1-S10) and writers (K1-K5) for the corpus file formats."""
