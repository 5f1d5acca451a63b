"""Readers, writers and rule tables."""
