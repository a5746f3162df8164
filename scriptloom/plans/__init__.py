"""Whole runs built from the operators, as a user starts them."""
