"""Whitening of embeddings by the covariance of their vectors, each different vector once with its multiplicity as weight.

Vectors become whole numbers, so equal ones can be grouped exactly. Sums, covariance, projection and distances are taken
over the different vectors only; their rows get the results back by a digest of the vector. Every task multiplies the
centred, weighted matrix of its rows with itself and sends the upper half; the driver holds what has the size of the
covariance and no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pathloom.llm.common import discard, small_batches, spread_join, written

#: An entry c of a vector becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Entries beyond would not be whole numbers of 64 bits; their vectors are left out as if they were infinite.
MOST = 2.0**50
#: Vectors that a task multiplies at a time.
ROWS = 4096

_KEYED = "key binary, seen bigint"


def _matrix(keys: pa.Array, size: int) -> np.ndarray:
    """Vectors from their bytes: 4 bytes a number, or 8 where one needs them."""
    raw = keys.to_pylist()
    wide = np.array([len(k) == 8 * size for k in raw], bool)
    out = np.empty((len(raw), size), np.int64)
    for kind, which in (("<i8", wide), ("<i4", ~wide)):
        out[which] = 0 if not which.any() else np.frombuffer(b"".join(k for k, w in zip(raw, which, strict=True) if w), kind).reshape(-1, size)
    return out


def _packed(rows: DataFrame, id: str, vector: str) -> tuple[DataFrame, int]:
    """``id, key`` of the vectors that take part, their numbers as bytes; and the vectors' length."""
    usable = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < MOST, F.lit(False)))
    found = rows.select(id, vector).filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & usable)
    usual = found.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = usual[0]["size"] if usual else 0
    found = found.filter(F.size(vector) == size).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            x = np.floor(SCALE * c).astype(np.int64) + OFFSET
            small = np.abs(x).max(axis=1) < 2**31
            keys = [(r.astype("<i4") if s else r.astype("<i8")).tobytes() for r, s in zip(x, small, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary())], ["id", "key"])

    schema = StructType([StructField("id", rows.schema[id].dataType), *StructType.fromDDL("key binary").fields])
    return found.mapInArrow(pack, schema), size


def _sums(size: int):
    """Exact sums of each dimension, weighted: a row for each dimension and task."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x, w = _matrix(part.column("key"), size), part.column("w").to_numpy()
                safe = int(np.abs(x).max()) * int(w.sum()) < 2**62
                own = (w @ x).tolist() if safe else (w.astype(object) @ x.astype(object)).tolist()
                total = [a + b for a, b in zip(total, own, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["dim", "total"])

    return rows


def _products(centred: Callable[[pa.RecordBatch], np.ndarray], size: int):
    """Weighted products of centred rows with themselves: the upper half of a matrix for each task."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                c = centred(part)
                total += (c * part.column("w").to_numpy()[:, None]).T @ c
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    return rows


def _covariance(fit: DataFrame, centred: Callable[[pa.RecordBatch], np.ndarray], size: int, n: int) -> np.ndarray:
    """Covariance with divisor ``n``; the driver gets one row for each entry of the upper half."""
    parts = fit.mapInArrow(_products(centred, size), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((size, size))
    out[parts["i"], parts["j"]] = out[parts["j"], parts["i"]] = parts["v"] / n
    return out


def _centre(size: int, total: list[int], n: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    """x - S / n, the whole part of S / n taken off exactly."""
    whole = np.array([t // n for t in total], np.int64)
    rest = np.array([t % n / n for t in total])
    return lambda part: (_matrix(part.column("key"), size) - whole).astype(np.float64) - rest


def _projected(size: int, total: list[int], n: int, weights: np.ndarray, known: np.ndarray):
    """A row for each different vector: its coordinates and its exact deviation."""
    centre = _centre(size, total, n)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x, z = _matrix(part.column("key"), size), centre(part) @ weights
                most = n * int(np.abs(x).max()) + max(abs(t) for t in total)
                if most**2 * size < 2**62:
                    d = x * n - np.array(total, np.int64)
                    deviation = pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    exact = [sum((n * v - t) ** 2 for v, t in zip(r, total, strict=True)) for r in x.tolist()]
                    deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
                values = pa.array(z.ravel(), mask=np.tile(~known, len(z)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * len(known)), values)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("seen"), part.column("w"), deviation, lists], ["key", "seen", "w", "deviation", "z"])

    return rows


def whitened(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 8, weights: str = "counts") -> DataFrame:
    """Coordinates of each row's vector on the components of largest variance, each of variance 1: ``id, component, n,
    deviation, whitened, explained, identity_error``, a row for each row and component.

    ``weights`` is counts, every row counts, or one, every different vector counts once; ``n`` is their sum. Vectors
    that are null or empty, hold null or non-finite entries or such beyond ``MOST`` / ``SCALE``, or have another length
    than most (the longer one of equally many) are left out. Rows that repeat an id, and null ids, stay. A component
    without variance has null for ``whitened`` and takes no part in ``identity_error``; without any variance
    ``explained`` is null. ``deviation`` is a decimal, null beyond 38 digits. Other columns of ``rows`` are left behind;
    an empty table gives no rows.
    """
    packed, size = _packed(rows, id, vector)
    result = StructType([StructField(id, rows.schema[id].dataType), *StructType.fromDDL("component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double").fields])
    if not size:
        return rows.sparkSession.createDataFrame([], result)
    mark = F.unhex(F.sha2("key", 256))
    fit = written(packed.groupBy("key").agg(F.count(F.lit(1)).alias("seen")).withColumn("w", F.col("seen") if weights == "counts" else F.lit(1).cast("long")))
    n, total_rows = fit.agg(F.sum("w"), F.sum("seen")).first()
    sums = fit.mapInArrow(_sums(size), "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("t")).collect()
    total = [int(r["t"]) for r in sorted(sums, key=lambda r: r["dim"])]
    covariance = _covariance(fit, _centre(size, total, n), size, n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1, 1)
    known = values > max(values[0], 0.0) * size * 1e-14
    scale = np.where(known, 1 / np.sqrt(np.where(known, values, 1.0)), 0.0)
    z = written(fit.mapInArrow(_projected(size, total, n, vectors * scale, known), f"{_KEYED}, w bigint, deviation decimal(38,0), z array<double>").select(mark.alias("mark"), "seen", "w", "deviation", "z"))
    discard(fit)
    error = _identity_error(z, known, n)
    trace = float(np.trace(covariance))
    share = F.array(*[F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values])
    ids = written(packed.select("id", mark.alias("mark")))
    met = spread_join(ids, z.drop("w"), ["mark"], "seen", total_rows)
    out = met.select("id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select(F.col("id").alias(id), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def _identity_error(z: DataFrame, known: np.ndarray, n: int) -> float:
    """Largest absolute entry of the coordinates' covariance less the identity, over the components that have variance."""
    if not known.any():
        return 0.0
    means = z.select("w", F.posexplode("z").alias("at", "v")).groupBy("at").agg((F.sum(F.col("w") * F.col("v")) / n).alias("m")).toPandas()
    mean = np.zeros(len(known))
    mean[means["at"]] = means["m"].fillna(0.0)

    def centred(part: pa.RecordBatch) -> np.ndarray:
        flat = part.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(known))
        return np.nan_to_num(flat - mean)

    found = _covariance(z, centred, len(known), n)[np.ix_(known, known)]
    return float(np.abs(found - np.eye(len(found))).max())


def _op11(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {"op11_whitening": _op11}
