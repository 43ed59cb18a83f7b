"""Operators for building language-model training corpora. Nothing outside imports this."""
