"""Readers and writers; schemas are declared, never inferred."""
