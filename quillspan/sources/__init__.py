"""Readers, wildcard tables and the shared work folder."""
