import pytest

import corpus_pipeline
from quirework.llm import registry, toxicity
from quirework.llm.common import forget_written, written
from test_near_dedup import brute
from test_packing import check, plain_ids
from test_repeats_and_benchmark import shingles


def by_hand(spark, rows, sf_dir):
    """doc_ids that each stage but the last keeps of (doc_id, text) rows, stage after stage, by brute force."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = toxicity.Scorer(model.params).score([t for _, t in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD]
    yield "toxicity", {r[0] for r in rows}
    last = {}
    for i, t in rows:
        last[t or ""] = max(i, last.get(t or "", i))
    rows = [r for r in rows if last[r[1] or ""] == r[0]]
    yield "exact_dedup", {r[0] for r in rows}
    head, _ = brute(rows, 5, 80)
    rows = [r for r in rows if head[r[0]] == r[0]]
    yield "near_dedup", {r[0] for r in rows}
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    sets = {i: shingles(t) for i, t in rows}
    yield "decontamination", {i for i, s in sets.items() if not any(x and 100 * len(x & s) >= 80 * len(x) for x in items)}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    want = dict(by_hand(spark, list(texts.items()), sf_dir))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns
        assert {r.doc_id for r in docs.collect()} == want[name], name
    assert len({len(x) for x in want.values()}) == 4 and want["decontamination"]
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    left = sorted(want["decontamination"])
    assert check(got.collect(), dict(zip(left, plain_ids([texts[i] for i in left]), strict=True))) < 0.05
    forget_written(spark)


def test_stages_on_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs, sf_dir).count() > 0, name
        assert stage(spark, no_docs, sf_dir).count() == 0, name


def test_stages_pass_any_columns(spark, sf_dir):
    names = ["score", "recipe", "kept", "keep_id", "row", "row_key", "_words_hash", "_k1", "star", "bucket", "gone"]
    rows = [(i, f"words of text {i} that are like no others {i * 7} here", *names) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert sorted(map(tuple, docs.collect())) == rows, name


def test_every_operator_is_registered():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)} | {"instruction"}
    assert set(registry.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, sf_dir)
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in df.collect()))) == sorted(map(repr, want.fetchall()))
