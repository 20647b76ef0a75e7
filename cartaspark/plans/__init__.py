"""Whole procedures and the registered queries."""
