"""Readers, writers and landed-document flattening."""
