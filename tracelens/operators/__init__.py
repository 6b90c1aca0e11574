"""Relational operators over traces and object sets."""
