"""Composed jobs: the stand-in inputs, the registered queries and their SQL oracles."""
