"""Whole plans composed from the operators."""
