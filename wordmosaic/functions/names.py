"""Image names: one spelling for every way a file of the image is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The endings and the prefix that file names carry besides the image name.
ENDINGS = (".jpg.hesaff.sift", ".txt", ".jpg")
PREFIX = "oxc1_"


def image_name(column: Column) -> Column:
    """The bare image name: without the prefix and without one known ending; null stays null.

    >>> "oxc1_all_souls_000001.jpg"  ->  "all_souls_000001"
    """
    bare = F.regexp_replace(column, "(\\.jpg\\.hesaff\\.sift|\\.txt|\\.jpg)$", "")
    return F.when(bare.startswith(PREFIX), F.substring(bare, len(PREFIX) + 1, 2_000_000)).otherwise(bare)


def without(column: Column, *parts: str) -> Column:
    """Every occurrence of the given literal parts removed, in order (no pattern matching)."""
    for part in parts:
        column = F.replace(column, F.lit(part), F.lit(""))
    return column


def as_jpg(column: Column) -> Column:
    """File name of the picture: prefix removed, ``.jpg`` appended."""
    return F.concat(without(column, PREFIX), F.lit(".jpg"))
