"""Operators: pure DataFrame -> DataFrame functions with an explicit as_of."""
