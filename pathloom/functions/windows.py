"""Windows over ordered rows: forward fill, islands, and the two-level form for very long jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(*keys: str, by: str = "seq") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def ffill(value: Column, w: WindowSpec) -> Column:
    """The last non-null value up to and including this row."""
    return F.last(value, ignorenulls=True).over(so_far(w))


def islands(starts: Column, w: WindowSpec) -> Column:
    """Number of rows so far at which a new island starts."""
    return F.sum(starts.cast("int")).over(so_far(w))


def long_scan(df: DataFrame, key: str, order: str, sums: dict[str, str], fills: dict[str, str], block_rows: int = 65536, befores: dict[str, str] | None = None) -> DataFrame:
    """Running sums and forward fills of jobs of any length: blocks first, then a scan of the blocks' summaries.

    ``sums`` and ``fills`` map new columns to source columns, this row included; ``befores`` are fills from the rows before
    only. Blocks are ranges of ``order``, a whole number. No task holds more than a block of rows or the summaries of one
    key, so one giant job is as parallel as many small ones.
    """
    befores = befores or {}
    rows = df.withColumn("__block", F.floor(F.col(order) / block_rows))
    inner = Window.partitionBy(key, "__block").orderBy(order)
    for new, old in sums.items():
        rows = rows.withColumn(new, F.sum(old).over(so_far(inner)))
    for new, old in fills.items():
        rows = rows.withColumn(new, F.last(old, ignorenulls=True).over(so_far(inner)))
    for new, old in befores.items():
        rows = rows.withColumn(new, F.last(old, ignorenulls=True).over(before(inner)))
    carried_fills = fills | befores
    summary = rows.groupBy(key, "__block").agg(
        *[F.sum(old).alias(f"__s_{new}") for new, old in sums.items()],
        *[F.max_by(old, F.when(F.col(old).isNotNull(), F.col(order))).alias(f"__f_{new}") for new, old in carried_fills.items()],
    )
    line = before(Window.partitionBy(key).orderBy("__block"))
    carried = summary.select(
        F.col(key).alias("__key"), F.col("__block").alias("__b"),
        *[F.sum(f"__s_{new}").over(line).alias(f"__s_{new}") for new in sums],
        *[F.last(f"__f_{new}", ignorenulls=True).over(line).alias(f"__f_{new}") for new in carried_fills],
    )
    out = rows.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__b")))
    for new in sums:
        out = out.withColumn(new, F.coalesce(F.col(new), F.lit(0)) + F.coalesce(f"__s_{new}", F.lit(0)))
    for new in carried_fills:
        out = out.withColumn(new, F.coalesce(new, f"__f_{new}"))
    return out.select(*df.columns, *sums, *carried_fills)
