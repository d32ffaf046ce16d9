"""Name folding and distances as columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_punctuation(name: Column) -> Column:
    return F.regexp_replace(name, r"\p{Punct}", "")


def lower_ascii(name: Column) -> Column:
    return F.translate(name, string.ascii_uppercase, string.ascii_lowercase)


def name_distance(a: Column, b: Column) -> Column:
    """Differing positions of the UTF-8 bytes; each surplus byte counts one."""
    octets = lambda name: F.regexp_extract_all(F.hex(name), F.lit("(..)"), F.lit(1))
    marks = F.zip_with(
        octets(a), octets(b), lambda x, y: (~x.eqNullSafe(y)).cast("bigint")
    )
    return F.aggregate(marks, F.lit(0).cast("bigint"), lambda s, x: s + x)


def file_stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")
