"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quirework-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint: ends the lineage in the shared folder, so that a lost executor costs no rerun of what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), as compressed Parquet; for tables that are read several times with different columns."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/quirework-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_written(spark: SparkSession) -> None:
    """Delete all tables that written() has made for this application; call it when their results have been stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/quirework-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def by_bytes(batch: pa.RecordBatch, column: str, rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many rows and, but for single rows, so many bytes in the column at most."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        held = total[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(total, held + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session's Arrow batches bounded to 2000 rows and 16 MB, unless they are set smaller or by the user.

    A batch is held by the executor's JVM and by its Python worker at once, beside the heap.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task and its stage, and shares its executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has them (in any case)."""
    taken = {c.lower() for c in columns}
    end = ""
    while any((n + end).lower() in taken for n in names):
        end += "_"
    return [n + end for n in names]


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, spread: Column, heavy: int = 1000, how: str = "left") -> DataFrame:
    """Add the columns of groups (one small row per key) to rows, without one task per large group.

    A group with more than 1/heavy of the n_rows rows is heavy. There are fewer than `heavy` of those whatever
    the input, so they are broadcast; all others are joined by key. `spread` gives the rows of heavy groups some
    other key of the same type, so that they don't meet in one task of the second join. Null keys match nothing.
    """
    facts = [c for c in groups.columns if c != key]
    k1, k2, k3, f1, f2, f = fresh([*rows.columns, *facts], "_k1", "_k2", "_k3", "_f1", "_f2", "_f")
    packed = groups.select(F.col(key).alias(k1), F.struct(*facts).alias(f1))
    is_heavy = F.col(f"{f1}.{size}") * heavy > n_rows
    near, far = packed.where(is_heavy), packed.where(~is_heavy).withColumnsRenamed({k1: k2, f1: f2})
    out = rows.join(F.broadcast(near), F.col(key) == F.col(k1), "left")
    out = out.withColumn(k3, F.when(F.col(f1).isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(spread))
    out = out.join(far, F.col(k3) == F.col(k2), "left")
    out = out.withColumn(f, F.when(F.col(key).isNotNull(), F.coalesce(f1, f2)))
    if how == "inner":
        out = out.where(F.col(f).isNotNull())
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], f"{f}.*")


def attach_large(rows: DataFrame, groups: DataFrame, key: str, size: str, salt: str, how: str = "inner", limit: int = 2000) -> DataFrame:
    """Add the columns of groups, however large their values, to rows that hold the size of their group and a salt (a hash).

    A group's row is copied once for each `limit` of its rows, and each copy is joined with its share of them, so no
    task gets more than about `limit` rows of one group and nothing is broadcast.
    """
    facts = [c for c in groups.columns if c not in (key, size)]
    share, k, s = fresh([*rows.columns, *facts], "_share", "_k", "_s")
    copies = F.ceil(F.col(size) / limit).cast("int")
    dealt = rows.withColumn(share, F.pmod(F.col(salt), copies).cast("int"))
    held = groups.select(F.col(key).alias(k), *facts, F.explode(F.sequence(F.lit(0), copies - 1)).alias(s))
    out = dealt.join(held, (F.col(key) == F.col(k)) & (F.col(share) == F.col(s)), how)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *facts)


def one_of_repeats(rows: DataFrame, id_col: str, same: Column) -> DataFrame:
    """rows, but of those that repeat an id and `same` (a null id is an id like others) only one.

    Ids that repeat are found first, by a shuffle of ids alone; only their rows are looked at further.
    """
    (key, mark) = fresh(rows.columns, "_id", "_same")
    repeated = cut(rows.groupBy(F.col(id_col).alias(key)).count().where("count > 1").select(key))
    if not repeated.limit(1).count():
        return rows
    known = F.broadcast(repeated) if repeated.count() < 1_000_000 else repeated
    among_them = F.col(id_col).eqNullSafe(F.col(key))
    single = rows.join(known, among_them, "left_anti")
    return single.unionByName(rows.join(known, among_them, "left_semi").withColumn(mark, same).dropDuplicates([id_col, mark]).select(*rows.columns))
