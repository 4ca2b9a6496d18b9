"""Column helpers on texts that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters that Unicode counts as white space.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(col: Column) -> Column:
    """col without white space of any kind around it."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def reference_key(col: Column) -> Column:
    """The comparable form of a reference: lower case, no white space around it,
    no folder before and no `.json` after the id; null for null, blank and `null`."""
    key = F.lower(strip(col))
    key = F.regexp_replace(key, r"\.json$", "")
    key = strip(F.element_at(F.split(key, "/"), -1))
    return F.when((key != "") & (key != "null"), key)
