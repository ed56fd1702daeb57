"""Word rules that several operators share, as Spark columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_words(text: Column, separator: str) -> Column:
    """The words of ``text`` in order; null and wordless texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")
