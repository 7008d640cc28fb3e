"""Operators for preparing language-model training data. Nothing else in skarn imports this package."""
