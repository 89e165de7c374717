"""Words of log text, cut alike everywhere in this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: everything that separates words in Unicode text.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def words(c: Column) -> Column:
    """The words of a text in lower case; null for null, an empty array for a blank text."""
    return F.filter(F.split(F.lower(c), SPACE), lambda w: w != "")
