"""Scalar helpers shared by the operators."""
