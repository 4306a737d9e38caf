"""Readers: files and formats to texts and blocks."""
