"""Operators that prepare large text, code and vector collections for model training."""
