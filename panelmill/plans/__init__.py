"""Operators composed into feature tables and reports."""
