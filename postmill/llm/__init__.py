"""Operators of training-data problems 1 to 10. Nothing outside this package imports it."""
