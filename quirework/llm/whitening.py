"""Whitening of embeddings by an exact, bit-sliced scatter matrix.

An entry c becomes the integer floor(64 * c) + 1000000. Each task takes the least value of each dimension off (the
shift) and packs what is left by bits: one plane per dimension and bit, 64 rows to a word. The sum of products of two
dimensions is then the sum over their planes of 2**(b + c) times the population count of the two planes' AND, which
is exact; shifts are undone in integers. A task hands on one row per pair of dimensions, whatever rows it read; these
are added as decimals of 38 digits. The driver gets d * (d + 1) / 2 sums for d dimensions, forms the covariance from
integers (n * sum(xy) - sum(x) * sum(y), which is its n * n-fold) and takes its eigenvectors. A second pass measures
the covariance of the whitened vectors, a third returns them; all three are narrow but for sums of fixed size.

Rules: rows whose vector is null or holds null, NaN or infinite entries are dropped; so are vectors of another length
than the most common one (of equally common ones the shortest), and vectors without entries. Integers saturate at
+-2**62. A null id is an id like others, repeated rows count and come out each. Components without variance (up to
the precision of doubles) don't exist and aren't returned: none for a single row or equal vectors. A deviation beyond
a long is null. An empty table gives an empty one. Only the two named columns are read, others play no part. Texts
don't occur here; a very long vector costs memory for the square of its length in each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import cut, table

#: Rows whose planes are held at once.
CHUNK = 8192
SCALE, OFFSET, MOST = 64, 1_000_000, 2.0**62


def sound(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def integers(vectors: pa.Array, d: int) -> np.ndarray:
    """The x-vectors of an Arrow list array whose lists all have d entries."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.clip(np.floor(SCALE * c), -MOST, MOST).astype(np.int64) + OFFSET


def planes(y: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of non-negative integers (rows, d) as words: (d * bits, rows / 64)."""
    y = np.pad(y, ((0, -len(y) % 64), (0, 0)))
    out = np.empty((y.shape[1], bits, len(y) // 64), np.uint64)
    for b in range(bits):
        out[:, b] = np.packbits(((y >> b) & 1).astype(np.uint8).T.copy(), axis=1, bitorder="little").view(np.uint64)
    return out.reshape(-1, len(y) // 64)


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and (in the upper triangle) sums of products of the columns of x, by AND and population count."""
    n, d = x.shape
    low = x.min(axis=0)
    bits = max(1, int((x.max(axis=0) - low).max()).bit_length())
    kind = np.int64 if 2 * bits + n.bit_length() < 60 and int(np.abs(x).max()) ** 2 * n < 1 << 60 else object
    p = planes(x - low, bits)
    weight = np.array([1 << b for b in range(bits)], dtype=kind)
    products = np.zeros((d, d), dtype=kind)
    for i in range(d):
        for b in range(bits):
            shared = np.bitwise_count(p[i * bits + b] & p[i * bits :]).sum(axis=1, dtype=np.int64)
            products[i, i:] += (shared.reshape(d - i, bits).astype(kind) @ weight) * weight[b]
    own = np.bitwise_count(p).sum(axis=1, dtype=np.int64).reshape(d, bits).astype(kind) @ weight
    low = low.astype(kind)
    products = products + np.outer(low, own) + np.outer(own, low) + n * np.outer(low, low)
    return own + n * low, products


def scatter(rows: DataFrame, vector: str) -> DataFrame:
    """d, i, j, total: per length d the number of vectors (i = j = -1), sums (i = -1) and sums of products (i <= j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}
        sums: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

        def add(d: int) -> None:
            x = np.concatenate(waiting.pop(d))
            s, p = cross_products(x)
            n, s0, p0 = sums.get(d, (0, 0, 0))
            sums[d] = (n + len(x), s0 + s.astype(object), p0 + p.astype(object))

        for batch in batches:
            held = batch.column(0)
            length = held.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(length):
                x = integers(held.filter(pa.array(length == d)), int(d))
                for at in range(0, len(x), CHUNK):
                    waiting.setdefault(int(d), []).append(x[at : at + CHUNK])
                    if sum(map(len, waiting[int(d)])) >= CHUNK:
                        add(int(d))
        for d in list(waiting):
            add(d)
        for d, (n, s, p) in sums.items():
            i, j = np.triu_indices(d)
            at_i, at_j = np.concatenate([[-1], np.full(d, -1), i]), np.concatenate([[-1], np.arange(d), j])
            total = [Decimal(int(v)) for v in (n, *s, *p[i, j])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), d), pa.int32()), pa.array(at_i, pa.int32()), pa.array(at_j, pa.int32()), pa.array(total, pa.decimal128(38, 0))], ["d", "i", "j", "total"])

    parts = rows.select(vector).mapInArrow(run, "d int, i int, j int, total decimal(38,0)")
    return parts.groupBy("d", "i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total"))


def fit(totals: DataFrame, most: int = 32) -> tuple[int, np.ndarray, np.ndarray, np.ndarray] | None:
    """n, sums, the whitening matrix (d, components) and the explained shares, or None without vectors."""
    usual = totals.where("i = -1 AND j = -1").orderBy(F.desc("total"), "d").first()
    if usual is None:
        return None
    n, d = int(usual["total"]), usual["d"]
    s, products = np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
    for r in totals.where((F.col("d") == d) & (F.col("j") >= 0)).select("i", "j", "total").collect():
        if r["i"] < 0:
            s[r["j"]] = int(r["total"])
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = int(r["total"])
    centred = n * products - np.outer(s, s)
    v = np.array([[a / (n * n) for a in line] for line in centred.tolist()], dtype=np.float64)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    trace = float(np.trace(v))
    real = np.flatnonzero(e > max(trace, 0.0) * d * np.finfo(float).eps)[:most]
    return n, s, u[:, real] / np.sqrt(e[real]), e[real] / trace if len(real) else e[real]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType
    schema = f"{id_col} {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where(sound(F.col("vector")))
    model = fit(cut(scatter(rows, "vector")), most)
    if model is None:
        return spark.createDataFrame([], schema)
    n, s, matrix, explained = model
    d, k = matrix.shape

    def deviations(batch: pa.RecordBatch) -> np.ndarray:
        """n * x - S for the batch's vectors, exact."""
        x = integers(batch.column("vector"), d)
        small = n * int(np.abs(x).max(initial=0)) < 1 << 61
        return n * x.astype(np.int64 if small else object) - s.astype(np.int64 if small else object)

    def projected(off: np.ndarray) -> np.ndarray:
        return (off / n).astype(np.float64) @ matrix

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = projected(deviations(batch))
            first, second = first + w.sum(axis=0), second + w.T @ w
        i, j = np.triu_indices(k)
        at_i, at_j = np.concatenate([np.full(k, -1), i]), np.concatenate([np.arange(k), j])
        yield pa.RecordBatch.from_arrays([pa.array(at_i, pa.int32()), pa.array(at_j, pa.int32()), pa.array(np.concatenate([first, second[i, j]]))], ["i", "j", "total"])

    def output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                off, m = deviations(batch), batch.num_rows
                exact = off if off.dtype != object and d * int(np.abs(off).max(initial=0)) ** 2 < 1 << 62 else off.astype(object)
                square = (exact * exact).sum(axis=1).tolist()
                deviation = pa.array([v if v < 1 << 63 else None for v in square], pa.int64())
                at_row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(at_row), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), deviation.take(at_row), pa.array(projected(off).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    if not k:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == d)
    sums = {(r["i"], r["j"]): r["total"] / n for r in rows.mapInArrow(moments, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    error = max(abs(v - sums[-1, i] * sums[-1, j] - (i == j)) for (i, j), v in sums.items() if i >= 0)
    return rows.mapInArrow(output, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
