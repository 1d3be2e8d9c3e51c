"""Readers, writers and the stored tables around them."""
