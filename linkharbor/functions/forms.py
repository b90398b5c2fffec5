"""Forms of the outcome columns: anchored patterns and range checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms that the data contract states.
HASH_FORM = r"\A[0-9a-f]{32}\z"
SIZE_FORM = r"\A[1-9][0-9]{0,8}\z"
SIZE_MAX = 536_870_912
MIME_FORM = r"\A(?:unspecified|[a-z0-9.+-]+/[a-z0-9.+-]+)\z"
MIME_CHARS = 255


def is_flag(c: Column) -> Column:
    return c.isin("true", "false")


def is_hash(c: Column) -> Column:
    return c.rlike(HASH_FORM)


def is_size(c: Column) -> Column:
    """A whole number from 1 to 512 MB in ASCII digits."""
    return c.rlike(SIZE_FORM) & (c.try_cast("bigint") <= SIZE_MAX)


def is_mime(c: Column) -> Column:
    return c.rlike(MIME_FORM) & (F.length(c) <= MIME_CHARS)


def size_value(c: Column) -> Column:
    """The size as a number, NULL where the cell is not of its form."""
    return F.when(is_size(c), c.try_cast("bigint"))
