"""Running sums, percentiles and greedy admission against plain loops, with a group that holds most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.operators import ranked


@pytest.fixture(autouse=True)
def several_slices(spark):
    """Small tables would be put into one slice otherwise."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [(rng.choice([None, "hot", "hot", "hot", "hot", f"g{i % 9}"]), i, rng.randint(0, 900), rng.choice([None, rng.random(), 0.5])) for i in range(3000)]


SCHEMA = "g string, at long, size long, value double"


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_running_sum(spark, rows):
    slices = ranked.ranged(spark.createDataFrame(rows, SCHEMA), ["g"], ["at"])
    assert slices.where("g = 'hot'").select("part").distinct().count() > 1
    got = {r["at"]: (r.before, r.total) for r in ranked.running_sum(slices, ["g"], ["at"], "size").collect()}
    assert len(got) == len(rows)
    for of in groups(rows).values():
        before = 0
        for r in of:
            assert got[r[1]] == (before, sum(x[2] for x in of))
            before += r[2]


def test_percentiles(spark, rows):
    df = spark.createDataFrame([*rows, ("empty", 1, 1, None), ("one", 1, 1, 2.5)], SCHEMA)
    got = {r.g: (r.p0, r.p50, r.p95, r.p100) for r in ranked.percentiles(df, ["g"], "value", {"p0": 0, "p50": 0.5, "p95": 0.95, "p100": 1}).collect()}
    assert "empty" not in got and got["one"] == (2.5,) * 4
    for g, of in groups(rows).items():
        assert got[g] == pytest.approx(np.quantile([r[3] for r in of if r[3] is not None], [0, 0.5, 0.95, 1]))
    whole = ranked.percentiles(df, [], "value", {"p50": 0.5}).collect()
    assert whole[0].p50 == pytest.approx(np.median([r[3] for r in rows if r[3] is not None] + [2.5]))


@pytest.mark.parametrize("rounds", [30, 1, 0])
def test_greedy_admission(spark, rows, rounds):
    room = {"hot": 200_000, "g1": 0, "g2": 450, "g3": 10**9, None: 3000}
    df = spark.createDataFrame([(*r, room.get(r[0], 2000)) for r in rows], SCHEMA + ", room long").withColumn("fits", F.lit(1))
    got = {r["at"]: r.accepted for r in ranked.admit_greedily(df.drop("fits"), "g", ["at"], "size", "room", rounds).collect()}
    assert len(got) == len(rows)
    for g, of in groups(rows).items():
        used, limit = 0, room.get(g, 2000)
        for r in of:
            fits = limit <= 0 or used + r[2] <= limit
            assert got[r[1]] == fits
            used += r[2] if fits else 0
    assert not all(got.values())
