"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys are hashed to cells, a fixed number of small arcs of the ring. Each shard owns many virtual nodes. A cell goes
to the owner of the next virtual node clockwise; if that shard would pass its capacity, (1 + slack) times the mean
load, the cell goes on clockwise to the next shard with room. So no shard passes its capacity (but by a part of one
cell, if cells are too large to fit anywhere), and only what overflows moves. Large cells are placed first.

What the driver sees is the histogram over the cells: at most `cells` rows, plus parts of heavy cells, whatever the
input; the rows are placed by a join with that table. Rows of equal keys stay together, but for a key that outweighs
half a shard (fewer than two a shard can): it leaves its cell for one of its own, whose rows are split by their ids, so
that balance holds even if one key has a third of all rows. Slots are numbered from per-part counts and a rank inside
a part, so no task orders a whole shard or a hot key.

Rules: a null or empty text is one key of its own; its load is 1. A very long text is one load like others. A null id is
an id of its own. Repeated rows get a slot each. An empty table gives an empty one. Extra columns of any name but shard
and slot are passed through by shard().
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.common import fresh, table

def point(*what: object) -> int:
    """A place on the ring of 2**64 points."""
    return int.from_bytes(hashlib.blake2b(repr(what).encode(), digest_size=8).digest(), "big")


def place(units: list[tuple[int, int, int]], shards: int, virtual_nodes: int, slack: float) -> dict[tuple[int, int], int]:
    """Shard of each unit; units are (cell, part, load), part being -1 for a whole cell."""
    ring = sorted((point("node", s, v), s) for s in range(shards) for v in range(virtual_nodes))
    points = [p for p, _ in ring]
    capacity = (1 + slack) * sum(x[2] for x in units) / shards
    load, home = [0] * shards, {}
    for cell, part, size in sorted(units, key=lambda x: (-x[2].bit_length(), point("unit", x[0], x[1]))):
        at, tried = bisect.bisect(points, point("cell", cell, part)), set()
        for k in range(len(ring)):
            s = ring[(at + k) % len(ring)][1]
            if s in tried:
                continue
            tried.add(s)
            if load[s] + size <= capacity:
                break
            if len(tried) == shards:
                s = min(range(shards), key=lambda x: (load[x], x))
                break
        home[cell, part] = s
        load[s] += size
    return home


def shard(rows: DataFrame, key: Column, load: Column, row_id: Column, shards: int = 8, virtual_nodes: int = 128, slack: float = 0.001, cells: int = 1 << 16) -> DataFrame:
    """Add shard and slot (gapless in the shard)."""
    cell, key_, load_, id_, part, parts_, base = fresh([*rows.columns, "shard", "slot"], "_cell", "_key", "_load", "_id", "_part", "_parts", "_base")
    light = rows.withColumns({cell: F.pmod(F.xxhash64(F.lit("cell"), key), F.lit(cells)), key_: F.xxhash64(F.lit("key"), key), load_: load, id_: F.xxhash64(row_id)})
    spark = rows.sparkSession

    def sizes(of: DataFrame, *by: str) -> dict[tuple, tuple[int, int]]:
        found = of.groupBy(*by).agg(F.sum(load_).alias("load"), F.count("*").alias("n")).collect()
        return {tuple(r[: len(by)]): (r["load"], r["n"]) for r in found}

    whole: dict[int, tuple[int, int]] = {c: x for (c,), x in sizes(light, cell).items()}
    total, count = sum(x for x, _ in whole.values()), sum(n for _, n in whole.values())
    mean = max(total / shards, 1)
    torn = set()
    if full := [c for c, (x, _) in whole.items() if x > mean / 2]:
        heavy = light.where(F.col(cell).isin(full)).groupBy(cell, key_).agg(F.sum(load_).alias("load"), F.count("*").alias("n")).where(F.col("load") > mean / 2).orderBy(cell, key_).collect()
        own = F.col(cell)
        for i, (c, k, x, n) in enumerate(heavy):
            own = F.when((F.col(cell) == c) & (F.col(key_) == k), F.lit(cells + i)).otherwise(own)
            torn.add(cells + i)
            whole[cells + i], whole[c] = (x, n), (whole[c][0] - x, whole[c][1] - n)
        light = light.withColumn(cell, own.cast("long"))
        whole = {c: x for c, x in whole.items() if x[1]}
    #: A cell with far more rows or load than the usual is numbered, and if it is a heavy key's placed, in parts.
    parts = {c: k for c, (x, n) in whole.items() if (k := int(max(n * cells / 64 / max(count, 1), x * cells / 64 / max(total, 1), 64 * x / mean if c in torn else 0))) > 1}
    light = light.withColumn(part, F.lit(0).cast("long"))
    fine = {(c, 0): x for c, x in whole.items() if c not in parts}
    if parts:
        known = spark.createDataFrame(list(parts.items()), f"{cell} long, {parts_} long")  # at most 2 * cells / 64
        light = light.drop(part).join(F.broadcast(known), cell, "left").withColumn(part, F.when(F.col(parts_).isNull(), F.lit(0)).otherwise(F.pmod(id_, F.col(parts_))).cast("long")).drop(parts_)
        fine |= sizes(light.where(F.col(cell).isin(list(parts))), cell, part)
    units = [(c, -1, x) for c, (x, _) in whole.items() if c not in torn or c not in parts] + [(c, p, x) for (c, p), (x, _) in fine.items() if c in torn and c in parts]
    home = place(units, shards, virtual_nodes, slack)
    table_rows, used = [], [0] * shards
    for (c, p), (_, n) in sorted(fine.items()):
        s = home[(c, p) if (c, p) in home else (c, -1)]
        table_rows.append((c, p, s, used[s]))
        used[s] += n
    where = spark.createDataFrame(table_rows, f"{cell} long, {part} long, shard int, {base} long")
    placed = light.join(F.broadcast(where), [cell, part])
    rank = F.row_number().over(Window.partitionBy(cell, part).orderBy(row_id, load_))
    return placed.withColumn("slot", F.col(base) + rank - 1).select(*[F.col(f"`{c}`") for c in rows.columns], "shard", "slot")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_text"))
    out = shard(rows, F.col("_text"), F.col("size"), F.col("doc_id"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_sharding": op1_sharding}
ORACLES: dict[str, str] = {}
