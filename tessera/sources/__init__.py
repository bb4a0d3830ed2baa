"""Readers that turn tables into panels."""
