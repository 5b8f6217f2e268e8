"""Running sums, exact percentiles and greedy admission over groups of any size: no task has to hold or order a whole group."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df as it is now, checkpointed to the folder of spark.checkpoint.dir: what depends on partitions doesn't change any more."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="quirework-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def ranged(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with `part`: ascending slices of each group in that order, at most one for each partition."""
    return settled(rows.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()))


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[n]) for n in names))


def summed(slices: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """by, part, and the value's sum over the group's slices before this one and over all its slices; a row per group and slice."""
    own = slices.groupBy(*by, "part").agg(F.sum(value).alias("own"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("own").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.select(*by, "part", before.alias(f"{name}_before"), F.coalesce(F.sum("own").over(whole), F.lit(0)).alias(f"{name}_all"))


def running_sum(slices: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """ranged() rows with `before` (the sum of the value over earlier rows of the group) and `total`."""
    sums = summed(slices, by, F.col(value), "_sum")
    rows = slices.join(sums, _same(slices, sums, [*by, "part"])).drop(*[sums[n] for n in (*by, "part")])
    inside = F.sum(value).over(Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return rows.withColumn("before", F.col("_sum_before") + inside).withColumnRenamed("_sum_all", "total").drop("_sum_before")


def percentiles(rows: DataFrame, by: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """by and, under their names, exact percentiles with linear interpolation.

    Equal values are counted first; the counts' running sums say which values hold the two ranks around a percentile.
    Nulls don't count.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ranks = running_sum(ranged(counts, by, ["value"]), by, ["value"], "n")

    def held(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("value")))

    places = {name: (F.col("total") - 1) * F.lit(q) for name, q in named.items()}
    found = ranks.groupBy(*by).agg(
        *[held(F.floor(p)).alias(f"{name}_low") for name, p in places.items()], *[held(F.ceil(p)).alias(f"{name}_high") for name, p in places.items()], *[F.max(p - F.floor(p)).alias(f"{name}_share") for name, p in places.items()]
    )
    return found.select(*by, *[(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_share")).alias(name) for name in named])


def admit_greedily(rows: DataFrame, by: str, order: list[str], size: str, room: str, rounds: int = 30) -> DataFrame:
    """rows with accepted: in order, a row is accepted if it fits into what its group has room for beside those accepted
    before; a large one doesn't block a later, smaller one. A room of 0 or less has no end.

    Each round accepts, in every group, the rows up to the first that doesn't fit, by running sums, and drops those
    that are larger than the room that is left, which only shrinks. What is open after the rounds (sizes that just
    don't fit, over and over) is settled row by row, one task a group.
    """
    cells = rows.columns
    open_ = ranged(rows.withColumn("_left", F.col(room).cast("long")), [by], order)
    done = [open_.where(F.col("_left") <= 0).select(*cells, F.lit(True).alias("accepted"))]
    open_ = open_.where(F.col("_left") > 0)
    for _ in range(rounds):
        if open_.isEmpty():
            break
        sums = running_sum(open_, [by], order, size)
        judged = settled(sums.withColumn("fits", F.col("before") + F.col(size) <= F.col("_left")).drop("before", "total"))
        taken = summed(judged, [by], F.when(F.col("fits"), F.col(size)).otherwise(0), "_taken")
        rest = judged.where("NOT fits")
        rest = rest.join(taken, _same(rest, taken, [by, "part"])).drop(taken[by], taken["part"]).withColumn("_left", F.col("_left") - F.col("_taken_all")).drop("_taken_before", "_taken_all", "fits")
        hopeless = F.col(size) > F.col("_left")
        done += [judged.where("fits").select(*cells, F.lit(True)), rest.where(hopeless).select(*cells, F.lit(False))]
        open_ = settled(rest.where(~hopeless))
    else:
        done.append(_one_by_one(open_, by, order, size, cells))
    return reduce(DataFrame.union, done)


def _one_by_one(rows: DataFrame, by: str, order: list[str], size: str, cells: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, used = None, 0
        for b in batches:
            ok = []
            for group, n, left in zip(b[by], b[size], b["_left"], strict=True):
                of, used = group, used if group == of else 0
                ok.append(used + n <= left)
                used += n if ok[-1] else 0
            yield b[cells].assign(accepted=ok)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*cells).schema)
    return rows.repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, f"{schema}, accepted boolean")
