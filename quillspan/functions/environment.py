"""Functions of the session and of chance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def session_user() -> Column:
    return F.session_user()


def rand() -> Column:
    """At least 0 and below 1, another value for every row."""
    return F.rand()


def generate_uuid() -> Column:
    """A random UUID for every row, in lower case."""
    return F.uuid()
