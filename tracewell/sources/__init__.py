"""Readers and catalog listings."""
