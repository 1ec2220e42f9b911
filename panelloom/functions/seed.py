"""Seeded order from md5: the same numbers in Spark and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_order(seed: str, *keys: Column) -> Column:
    """The first 32 bits of md5(seed:key:...) as a long."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def keyed_fraction(seed: str, *keys: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of md5(seed:key:...)."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
