"""Registered queries over the library's operators and functions."""
