"""Dialect functions as builders of native Spark columns, one module a family."""
