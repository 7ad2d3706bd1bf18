"""Readers, dimensions and writers."""
