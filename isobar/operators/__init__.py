"""Operators on fields and points as DataFrame plans."""
