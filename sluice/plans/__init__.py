"""Composite jobs a user runs."""
