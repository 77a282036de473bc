"""Readers, writers and event codecs."""
