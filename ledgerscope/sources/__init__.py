"""Readers, writers and the canonical views."""
