"""How large tables meet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast. Spark estimates a side from the bytes of its files; rows that are exploded, or
    packed well on disk, are many times that, and a broadcast of them goes through the driver's memory."""
    return side.hint("merge")
