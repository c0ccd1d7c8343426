"""Path and hash spellings brought to one form, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_path(c: Column) -> Column:
    """Forward slashes, no doubled slash, no leading ``./``; null and blank stay null."""
    p = F.regexp_replace(F.translate(F.trim(c), "\\", "/"), "/{2,}", "/")
    p = F.regexp_replace(p, r"^(?:\./)+", "")
    return F.when(p != "", p)


def plain_hash(c: Column) -> Column:
    """Hash without case and surrounding blanks; blank counts as missing."""
    h = F.lower(F.trim(c))
    return F.when(h != "", h)


def repository(path: Column) -> Column:
    return F.substring_index(path, "/", 1)
