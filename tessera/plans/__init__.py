"""Formulas: parsing, checking and planning over panels."""
