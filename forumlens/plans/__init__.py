"""Whole jobs composed from the operators, and the registry of checked queries."""
