import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, whitened string, id int, vector int"


def rows_of(vectors):
    return [(i, v, i, i, "own", i, i) for i, v in enumerate(vectors)]


def brute(vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    return x, n, s, e[::-1], u[:, ::-1], v


def check(got, vectors, most=32):
    x, n, s, e, u, v = brute(vectors)
    k = min(most, int((e > np.trace(v) * len(e) * np.finfo(float).eps).sum()))
    assert len(got) == len(vectors) * k
    white = np.full((len(vectors), k), np.nan)
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r.vec_id], s, strict=True))
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-6) and r.identity_error < 1e-4
    want = (x - s / n) @ u[:, :k] / np.sqrt(e[:k])
    sign = np.sign((white * want).sum(axis=0))
    assert np.allclose(white, want * sign, atol=1e-6)


def test_by_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((300, 40)) * rng.uniform(0.1, 3, 40) + rng.uniform(-2, 2, 40)).astype(np.float32).tolist()
    df = spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(5)
    check(whitening.whiten(df).collect(), vectors)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    got = whitening.op12_whitening(spark, sf_dir).collect()
    at = {r.vec_id: i for i, r in enumerate(rows)}
    check([r.__class__(**(r.asDict() | {"vec_id": at[r.vec_id]})) for r in got], [r.embedding for r in rows])


def test_odd_rows(spark):
    good = [[0.5, 1.0, -2.0], [0.5, 1.5, 3.0], [1.5, -1.0, 0.25], [0.5, 1.0, -2.0]]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 1.0, 1.0]), (93, [float("-inf"), 1.0, 1.0]), (94, []), (95, [1.0, 2.0])]
    df = spark.createDataFrame([*rows_of(good), *[(i, v, None, None, None, None, None) for i, v in odd]], SCHEMA)
    check(whitening.whiten(df).collect(), good)
    assert whitening.whiten(df.where("vec_id >= 90")).count() == 0
    assert whitening.whiten(df.where("vec_id IN (0, 3)")).count() == 0
    assert whitening.whiten(df.where("false")).count() == 0
    twice = whitening.whiten(df.union(df)).collect()
    assert len(twice) == 8 * 2 and twice[0].n == 8
    nameless = whitening.whiten(spark.createDataFrame([(None, [1.0]), (None, [2.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted(round(r.whitened, 9) for r in nameless) == [-1.0, 1.0]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6).flatmap(lambda d: st.lists(st.lists(st.integers(-(2**31), 2**31) | st.integers(0, 3), min_size=d, max_size=d), min_size=1, max_size=150)))
def test_products_are_exact(rows):
    x = np.array(rows, dtype=np.int64)
    s, p = whitening.cross_products(x)
    big = x.astype(object)
    assert s.tolist() == big.sum(axis=0).tolist()
    assert np.triu(p).tolist() == np.triu(big.T @ big).tolist()
