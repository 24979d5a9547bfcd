"""Corpus operators for language-model training data, with their queries."""
