"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.loops import discard, saved, shared_folder, spread_join

__all__ = ["WORD", "discard", "held_out", "learning_sample", "set_aside", "share_of", "shared_dir", "size_of", "small_batches", "spread_join", "written"]

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; an error on a cluster that has none set."""
    return shared_folder(spark)


def written(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again."""
    return saved(df.select(*columns) if columns else df)


def small_batches(spark: SparkSession) -> None:
    """For the registered queries and the pipeline: hand 1,000 rows at a time to Python workers, unless the session says otherwise.

    Whole texts make large batches; Spark bounds them by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB) as
    well, which holds for operators that are called on their own.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in dict(spark.conf.getAll):
        spark.conf.set(key, "1000")


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with free room for new columns ``names``: columns of that name become ``<name>_given``, in any case.

    Column names clash without regard to case, as Spark resolves them so by default.
    """
    taken = {c.lower() for c in df.columns}
    for old in df.columns:
        if old.lower() in {n.lower() for n in names}:
            new = f"{old}_given"
            while new.lower() in taken:
                new += "_given"
            taken.add(new.lower())
            df = df.withColumnRenamed(old, new)
    return df


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for documents that no model may learn from: crc32 of the id as text, mod 4, is 2."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_of(value: Column, share: float | Column) -> Column:
    """True for about ``share`` of all values of a hash of ``value``."""
    return F.pmod(value, F.lit(1_000_003)) / F.lit(1_000_003.0) < share


def learning_sample(df: DataFrame, label: str, per_label: int, seed: int = 7) -> DataFrame:
    """About ``per_label`` rows of each label value, chosen by a hash of ``doc_id``; null labels are left out.

    The bound is what keeps a fit on the driver small. A model has its label values on the driver anyway, so their
    counts are gathered there too; counting reads the label and id columns only.
    """
    named = df.filter(F.col(label).isNotNull())
    counts = [(r[0], r[1]) for r in named.groupBy(label).agg(F.count(F.lit(1))).collect()]
    if not counts:
        return named
    share = F.create_map(*[F.lit(x) for value, n in counts for x in (value, min(1.0, per_label / n))])
    return named.filter(share_of(F.xxhash64(F.lit(seed), F.col("doc_id")), F.element_at(share, F.col(label))))
