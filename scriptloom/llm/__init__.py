"""Operators for preparing language-model training data, each by one named method."""
