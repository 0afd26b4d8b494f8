"""Readers and staging of tables."""
