"""Readers: any source becomes a table of texts with a row id."""
