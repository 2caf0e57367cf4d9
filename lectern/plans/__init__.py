"""Registered queries over the supplied tables."""
