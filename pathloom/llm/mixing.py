"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is a circular stream of its shuffled documents, cut into blocks of equally many words. Slots of the
mix are golden-ratio points mapped through the cumulative target weights; the r-th slot of a source takes its r-th
block, beginning again after the last one. Slots and blocks meet in one equi-join on (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import size_of, spread_join, written

GOLDEN = 0.6180339887498949
#: Documents of a source fall into hash buckets of about so many rows; running sums are taken in two levels.
BUCKET_ROWS = 2000
#: Repeated ids up to this number (8 bytes each) are broadcast to pick their rows; more are joined by a shuffle.
BROADCAST_IDS = 100_000


def source_targets(sizes: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """One row per source: ``source, source_size, n_docs, target``.

    Sources in code point order (null last) weigh ``weights`` in turn and share ``share`` times all words; none gets
    more than ``most`` times its own words, the excess goes to the others by weight. That is a water level: sorted by
    cap / weight, the sources below the level are a prefix, so running sums give it without repeated passes. The
    table has one row per source, whatever the number of documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("rank", rank).withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    total = F.sum("source_size").over(everywhere) * F.lit(float(share))
    per = (
        per.withColumn("total", total)
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("w_left"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("final", F.min(F.when(F.col("open"), F.struct("cap_before", "level"))).over(everywhere)["level"])
    )
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _streams(sizes: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Documents with ``at``, the words before them in their source's shuffled stream. A hot source is many buckets."""
    # Sources meet their documents as keys without nulls; those of many documents are broadcast, the others joined.
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    per = written(targets.select(key.alias("__s"), "source_size", "target", "n_docs", F.col("n_docs").alias("__w")))
    total = per.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    rows = spread_join(sizes.withColumn("__s", key), per, ["__s"], "__w", total).drop("__s")
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("copy"))
    buckets = (F.col("n_docs") / F.lit(float(BUCKET_ROWS))).cast("long") + 1
    rows = rows.withColumn("draw", draw).withColumn("bucket", F.pmod(F.shiftright(F.col("draw"), 16), buckets)).drop("n_docs")
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size")
    rows = rows.withColumn("at", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    line = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = by_bucket.select("source", "bucket", F.coalesce(F.sum("words").over(line), F.lit(0)).alias("head"))
    heads = heads.select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), "head")
    joined = rows.join(heads, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    return joined.withColumn("at", F.col("at") + F.col("head")).drop("__s", "__b", "head", "bucket", "draw")


def _planned(per: DataFrame, block: int) -> DataFrame:
    """Per source: whole words to take (``quota``), blocks in an epoch and slots that the quota needs."""
    quota = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    full = F.floor(F.col("quota") / F.col("source_size")).cast("long")
    rest = F.ceil((F.col("quota") - F.col("full") * F.col("source_size")) / F.lit(block)).cast("long")
    return (
        per.filter((F.col("source_size") > 0) & (F.col("target") >= 0.5))
        .withColumn("quota", quota)
        .withColumn("blocks", blocks)
        .withColumn("full", full)
        .withColumn("slots", F.col("full") * F.col("blocks") + rest)
        .drop("full")
    )


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """Slots of the mix: ``slot, source, turn, block, epoch, length``.

    Point i is the fractional part of (i + 1) times the golden ratio's inverse; it picks the source in whose span of
    the cumulative slot weights it falls. ``turn`` ranks the slots of a source. A source's points may fall short of
    or beyond its plan by a few: the latter are dropped, the former added at the end, so that plans are met exactly.
    """
    spark = targets.sparkSession
    plan = _planned(targets, block)
    spans = Window.orderBy(F.col("source").asc_nulls_last())
    plan = plan.withColumn("hi", F.sum("slots").over(spans.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("slots"))
    plan = written(plan)
    n, sources = plan.agg(F.max("hi"), F.count(F.lit(1))).first()
    n = n or 0
    # Points find their span by an equi-join on cells of the axis: a few cells for each source.
    width = max(n, 1) / (8.0 * max(sources, 1))
    cells = F.sequence(F.floor(F.col("lo") / F.lit(width)), F.floor(F.col("hi") / F.lit(width)))
    spread = plan.withColumn("cell", F.explode(cells))
    point = F.pmod((F.col("slot") + 1) * F.lit(GOLDEN), F.lit(1.0)) * F.lit(float(n))
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", point)
    slots = slots.withColumn("cell", F.floor(F.col("point") / F.lit(width)))
    hit = slots.join(spread, "cell").filter((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    # Ranks within a source in two levels, runs of consecutive slots first, then the runs' counts; both of about equal size.
    run = F.floor(F.col("slot") / F.lit(max(64, int(n**0.5)))).cast("long")
    hit = hit.withColumn("run", run)
    inner = Window.partitionBy("source", "run").orderBy("slot")
    counts = hit.groupBy("source", "run").agg(F.count(F.lit(1)).alias("c"))
    line = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.select(F.col("source").alias("__s"), F.col("run").alias("__r"), F.coalesce(F.sum("c").over(line), F.lit(0)).alias("head"))
    ranked = hit.withColumn("turn", F.row_number().over(inner) - 1).join(heads, F.col("source").eqNullSafe(F.col("__s")) & (F.col("run") == F.col("__r")))
    ranked = ranked.withColumn("turn", (F.col("turn") + F.col("head")).cast("long")).filter(F.col("turn") < F.col("slots"))
    kinds = ["slot", "source", "turn", "blocks", "source_size", "quota"]
    ranked = ranked.select(*kinds)
    met = counts.groupBy("source").agg(F.sum("c").alias("met")).select(F.col("source").alias("__s"), "met")
    short = plan.join(met, F.col("source").eqNullSafe(F.col("__s")), "left").withColumn("met", F.coalesce("met", F.lit(0)))
    short = short.filter(F.col("met") < F.col("slots")).withColumn("turn", F.explode(F.sequence(F.col("met"), F.col("slots") - 1)))
    late = short.withColumn("slot", F.lit(n) + F.floor((F.col("turn") - F.col("met") + 0.5) / (F.col("slots") - F.col("met")) * F.lit(float(n))).cast("long"))
    both = ranked.unionByName(late.select(*kinds))
    epoch = F.floor(F.col("turn") / F.col("blocks")).cast("long")
    start = F.col("epoch") * F.col("source_size") + F.col("block") * F.lit(block)
    both = both.withColumn("epoch", epoch).withColumn("block", F.col("turn") - F.col("epoch") * F.col("blocks"))
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * F.lit(block), F.col("quota") - start)
    return both.withColumn("length", length.cast("long")).select("slot", "source", "turn", "block", "epoch", "length")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 2.0, block: int = 2048, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs(doc_id, text, source)``: (documents with sizes and targets, pieces in schedule order).

    Documents: ``doc_id, copy, source, size, source_size, target, at``. Pieces: ``slot, turn, epoch, source, block, at,
    doc_id, copy, start, words``: the document's words from ``start`` on that the slot takes. Null and empty texts have size
    0 and are never taken. Repeated rows of a doc_id are told apart by ``copy``, their number among the rows of equal
    (source, doc_id, size). Null sources are one source, sorted last. A text of any length is cut into as many pieces as
    its blocks. Ties of the shuffle go by doc_id and size. Extra columns are ignored. An empty table gives empty results.
    """
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    # Equal rows are rare; number them so that each has its own place. Partial counts keep a hot id out of one task.
    once = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n"))
    targets = written(source_targets(sizes, share, weights, most))
    placed = written(_streams(sizes, targets, seed))
    slots = schedule(targets, block).withColumnRenamed("source", "__s").withColumnRenamed("block", "__b")
    first = F.floor(F.col("at") / F.lit(block)).cast("long")
    last = F.floor((F.col("at") + F.col("size") - 1) / F.lit(block)).cast("long")
    cut = placed.filter(F.col("size") > 0).withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at"), F.col("block") * F.lit(block))
    pieces = cut.join(slots, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")))
    stop = F.least(F.col("at") + F.col("size"), F.col("block") * F.lit(block) + F.col("length"))
    pieces = pieces.withColumn("start", begin - F.col("at")).withColumn("words", stop - begin).filter(F.col("words") > 0)
    return placed, pieces.select("slot", "turn", "epoch", "source", "block", "at", "doc_id", "copy", "size", "start", "words")


def taken(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per document row the words that the mix takes, repeats counted."""
    keys = ["doc_id", "copy", "source", "size", "at"]
    none = placed.select(*keys, "source_size", "target", F.lit(0).cast("long").alias("words"))
    some = pieces.select(*keys, F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), "words")
    return none.unionByName(some).groupBy(*keys).agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("words").cast("long").alias("taken"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row of ``docs`` once for each epoch in which the mix takes its first word.

    Rows keep their columns; documents without words and those that the mix leaves out go. Of rows that share doc_id,
    source and size, the first ones by a hash of the text, then by the text, are repeated more, so reruns agree. Texts
    are shuffled once, those of repeated keys twice.
    """
    placed, pieces = mix(docs, **options)
    keys = [F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z")]
    wanted = pieces.filter("start = 0").select(*keys, F.lit(1).alias("n"), F.lit(0).alias("k")).unionByName(placed.select(*keys, F.lit(0).alias("n"), F.col("copy").alias("k")))
    wanted = wanted.groupBy("__d", "__s", "__z").agg(F.sum("n").alias("__n"), F.max("k").alias("__k")).filter("__n > 0")
    wanted = written(wanted.withColumn("__same", F.xxhash64("__d", "__s", "__z")))
    source = F.col("source").cast("string")

    def met(rows: DataFrame, which: str) -> DataFrame:
        sized = rows.withColumn("__size", size_of(F.col("text"))).withColumn("__same", F.xxhash64("doc_id", source, "__size"))
        fits = F.col("doc_id").eqNullSafe(F.col("__d")) & source.eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))
        return sized.join(wanted.filter(which), "__same").filter(fits)

    rare = written(wanted.filter("__k > 1").select(F.xxhash64("__d", "__s").alias("__id")).distinct())
    rare = F.broadcast(rare) if rare.count() <= BROADCAST_IDS else rare
    few = docs.withColumn("__id", F.xxhash64("doc_id", source)).join(rare, "__id", "left_semi").drop("__id")
    rank = F.row_number().over(Window.partitionBy("__same", "__d", "__s", "__z").orderBy(F.xxhash64("text"), "text"))
    more = met(few, "__k > 1").withColumn("__i", rank)
    more = more.withColumn("__share", F.floor((F.col("__n") + F.col("__k") - F.col("__i")) / F.col("__k")).cast("int")).drop("__i")
    both = met(docs, "__k = 1").withColumn("__share", F.col("__n").cast("int")).unionByName(more)
    return both.withColumn("__e", F.explode(F.when(F.col("__share") > 0, F.sequence(F.lit(1), "__share")))).select(*docs.columns)


def _op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return taken(*mix(docs)).select("doc_id", "size", "source_size", "target", "taken", "source")


QUERIES = {"op1_mixing": _op1}
