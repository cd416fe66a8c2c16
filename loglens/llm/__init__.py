"""Operators for building language-model training data (one module each)."""
