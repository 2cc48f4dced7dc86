"""Operators, one module per family."""
