"""Readers, writers and the page API."""
