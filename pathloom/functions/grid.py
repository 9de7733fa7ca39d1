"""Equi-joins on grid cells in place of spatial ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float, reach: float = 0.0) -> DataFrame:
    """A row for each cell that a box, grown by ``reach``, touches: adds ``cx, cy`` and the first ones, ``cx0, cy0``."""
    def span(lo, hi):  # noqa: E306
        return F.sequence(F.floor((lo - reach) / size), F.floor((hi + reach) / size))
    first = df.withColumn("cx0", F.floor((x0 - reach) / size)).withColumn("cy0", F.floor((y0 - reach) / size))
    return first.withColumn("cx", F.explode(span(x0, x1))).withColumn("cy", F.explode(span(y0, y1)))


def joined(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Rows of both sides that share a cell, once each: a pair is kept in the lowest cell that both touch.

    Columns other than the keys and cells must differ between the sides.
    """
    right = b.withColumnsRenamed({"cx0": "__bx", "cy0": "__by"})
    # few bytes can have very many pairs, so the tasks of a join are not made by bytes
    spread = a.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "cx", "cy")
    both = spread.join(right, [*keys, "cx", "cy"])
    lowest = (F.col("cx") == F.greatest("cx0", "__bx")) & (F.col("cy") == F.greatest("cy0", "__by"))
    return both.filter(lowest).drop("cx", "cy", "cx0", "cy0", "__bx", "__by")
