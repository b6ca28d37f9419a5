"""Operators on text for training data. Nothing outside imports this package."""
