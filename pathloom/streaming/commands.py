"""Command streams: modal state and running time per job, newest generations, rasters that arrive in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pathloom.functions.loops import shared_folder
from pathloom.operators import commands as ops
from pathloom.operators import raster
from pathloom.operators.commands import rounded
from pathloom.sources.derive import cte, table

OUT = "job_id long, seq long, cmd string, power double, feed_rate double, distance double"
#: Next seq, power, feed rate, last x and y, distance so far, and rows that wait for a gap to close.
STATE = "next long, power double, feed double, x double, y double, distance double, waiting binary"
MOVES = ("MOVE_TO", "LINE_TO", "ARC_TO")
WAITING = pa.schema([("seq", pa.int64()), ("cmd", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("val", pa.float64())])


def _packed(rows: pd.DataFrame) -> bytes:
    """Rows as Arrow bytes, which keep every digit."""
    out = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(rows, schema=WAITING, preserve_index=False)
    with pa.ipc.new_stream(out, WAITING) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, gaps: bool = True) -> Iterator[pd.DataFrame]:
    """Rows of a job in the order of ``seq``; rows that come early wait in the state until the gap closes.

    Where ``gaps`` is false, missing rows are given up and all that wait goes on.
    """
    at, power, feed, x, y, distance, blob = state.get if state.exists else (0, 0.0, None, None, None, 0.0, None)
    rows = pd.concat([*batches, *([pa.ipc.open_stream(blob).read_pandas()] if blob else [])], ignore_index=True)
    rows = rows.sort_values("seq", kind="stable").drop_duplicates("seq")
    rows = rows[rows["seq"] >= at]
    out, done = [], 0
    for r in rows.itertuples():
        if r.seq != at and gaps:
            break
        if r.cmd == "SET_POWER" and pd.notna(r.val):
            power = float(r.val)
        elif r.cmd == "SET_FEED_RATE" and pd.notna(r.val):
            feed = float(r.val)
        elif r.cmd in MOVES:
            if x is not None:
                distance += ((r.x - x) ** 2 + (r.y - y) ** 2) ** 0.5
            x, y = float(r.x), float(r.y)
        out.append((key[0], int(r.seq), r.cmd, power, feed, distance))
        at, done = int(r.seq) + 1, done + 1
    left = rows.iloc[done:]
    state.update((at, power, feed, x, y, distance, _packed(left[WAITING.names]) if len(left) else None))
    yield pd.DataFrame(out, columns=["job_id", "seq", "cmd", "power", "feed_rate", "distance"])


def _expiring(milliseconds: int):
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield from _advance(key, iter([pd.DataFrame(columns=WAITING.names)]), state, gaps=False)
            state.remove()
            return
        yield from _advance(key, batches, state)
        state.setTimeoutDuration(milliseconds)

    return advance


def running_state(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """State and distance so far after each command of an unbounded stream ``(job_id, seq, cmd, x, y, val)``.

    With ``idle_ms``, jobs without rows for so long are forgotten, after the rows that still wait for a gap are let through; without, their state stays (and a run over what
    is available comes to its end).
    """
    rows = stream.select("job_id", "seq", "cmd", "x", "y", "val")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("job_id").applyInPandasWithState(_expiring(idle_ms) if idle_ms else _advance, OUT, STATE, "append", timeout)


def newest_requests(stream: DataFrame) -> DataFrame:
    """The latest generation of each key; late rows of lower generations change nothing."""
    return stream.groupBy("req_key").agg(F.max("generation").alias("generation"), F.max_by("payload", "generation").alias("payload"))


SLAB_OUT = "image_id long, y long, samples array<int>"
SLAB_STATE = "x array<int>, power array<int>"


def _row_parts(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pixels of one row: kept until all ``width`` of them are there, then sent on once; a pixel that comes again changes nothing."""
    known = dict(zip(*state.get, strict=True)) if state.exists else {}
    width = -1
    for batch in batches:
        width = int(batch["width"].max())
        for x, power in zip(batch["x"].tolist(), batch["power"].tolist(), strict=True):
            known.setdefault(int(x), int(power))
        if len(known) >= width and width >= 0:
            break
    before = state.exists and len(state.get[0]) >= width >= 0
    state.update(([int(x) for x in known], list(known.values())))
    if not before and len(known) >= width >= 0:
        yield pd.DataFrame({"image_id": [key[0]], "y": [key[1]], "samples": [[known[x] for x in sorted(known)]]})


def scan_slabs(stream: DataFrame) -> DataFrame:
    """Scanline rows ``image_id, y, samples`` of a stream of slabs of pixels ``(image_id, y, x, gray, a, width)``, each once.

    A row may be split over any slabs and files: its pixels wait in the state of its key until ``width`` of them have
    come. The state of a finished row stays as its mark, so pixels that are sent again make no second row.
    """
    rows = raster.power(stream, 0.1, 0.9, 16).select(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("long").alias("y"), F.col("x").cast("int").alias("x"), F.col("power").cast("int").alias("power"), "width")
    return rows.groupBy("image_id", "y").applyInPandasWithState(_row_parts, SLAB_OUT, SLAB_STATE, "append", GroupStateTimeout.NoTimeout)


# Queries: a derived table becomes files of a stream, which runs until they are read ---------------------------------


def _streamed(rows: DataFrame, files: int) -> DataFrame:
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession)
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _carried(spark, sf_dir: str) -> DataFrame:
    out = shared_folder(spark)
    live = running_state(_streamed(table(spark, sf_dir, "commands"), 4))
    live.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(OUT).parquet(out))


def _newest(spark, sf_dir: str) -> DataFrame:
    out = shared_folder(spark)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch:06d}")

    live = newest_requests(_streamed(table(spark, sf_dir, "requests").groupBy("req_key", "generation").agg(F.min("payload").alias("payload")), 4))
    live.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}-state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    return rounded(rows.groupBy("req_key").agg(F.max("generation").alias("generation"), F.max_by("payload", F.struct("generation", "epoch")).alias("payload")))


def _slabs(spark, sf_dir: str) -> DataFrame:
    """Pixels of all images in files that cut rows at any place, read two files at a time."""
    out = shared_folder(spark)
    pixels = table(spark, sf_dir, "pixels").withColumn("width", F.count(F.lit(1)).over(Window.partitionBy("image_id", "y")))
    live = scan_slabs(_streamed(pixels, 6))
    live.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SLAB_OUT).parquet(out).withColumn("samples", F.array_join("samples", ","))


QUERIES = {"stream_running_state": _carried, "stream_newest_requests": _newest, "stream_scan_slabs": _slabs}
ORACLE_SQL = {
    "stream_scan_slabs": f"{raster._POWER} SELECT image_id, y, string_agg(power, ',' ORDER BY x) AS samples FROM pw GROUP BY image_id, y",
    "stream_running_state": f"""{cte('commands')}, p AS (SELECT *, {ops._lag('x')} AS px, {ops._lag('y')} AS py, coalesce({ops._set('SET_POWER')}, 0) AS power, {ops._set('SET_FEED_RATE')} AS feed_rate FROM commands)
 SELECT job_id, seq, cmd, power, feed_rate, round(sum(CASE WHEN {ops.MOVE_SQL} THEN coalesce(sqrt((x - px) ** 2 + (y - py) ** 2), 0) ELSE 0 END) {ops.J} ROWS UNBOUNDED PRECEDING), 6) AS distance FROM p""",
    "stream_newest_requests": f"{cte('requests')} SELECT req_key, max(generation) AS generation, round(arg_max(payload, (generation, -payload)), 6) AS payload FROM requests GROUP BY req_key",
}
