"""Normal form of labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def term(c: Column | str) -> Column:
    """Lower case, each run of characters other than a-z and 0-9 made one space, trimmed; empty becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(""))
