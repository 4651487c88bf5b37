"""Operators that prepare text for model training."""
