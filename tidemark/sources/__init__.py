"""Inputs: landed files and test tables."""
