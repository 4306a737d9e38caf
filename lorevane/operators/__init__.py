"""Relational operators of retrieval and maintenance."""
