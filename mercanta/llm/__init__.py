"""Operators for training data and for text at scale. Nothing else in the package imports this one."""
