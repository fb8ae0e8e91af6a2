"""Readers, writers and derived layout tables."""
