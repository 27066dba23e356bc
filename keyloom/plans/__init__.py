"""Derived views and the query registry."""
