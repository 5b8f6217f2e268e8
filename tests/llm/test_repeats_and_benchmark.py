import hashlib
import math
from collections import Counter

import numpy as np

import pytest

from pyspark.sql import functions as F

from quirework.llm import decontamination, line_dedup, packing, substring_dedup


def brute(rows, window):
    words = [(t or "").encode().split() for t in rows]
    count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize(("window", "fan"), [(5, 256), (8, 256), (35, 256), (5, 3), (35, 3)])
def test_repeats_by_brute_force(odd_docs, odd_rows, window, fan, monkeypatch):
    """A fan of 3 makes three hops to the ranges."""
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 1 << 14)
    monkeypatch.setattr(substring_dedup, "RANGE_HASHES", 1 << 11)
    monkeypatch.setattr(substring_dedup, "FAN", fan)
    got = substring_dedup.drop_repeats(odd_docs, window)
    assert got.columns == [*odd_docs.columns, "n_words", "n_removed", "kept_text"]
    want = Counter((r[0], *x) for r, x in zip(odd_rows, brute([r[1] for r in odd_rows], window), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == want


def test_rows_of_a_chunk_do_not_grow_with_the_corpus():
    rng = np.random.default_rng(0)
    s = np.sort(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    for needed in (1, 200, 2500, 80_000, 800_000, 8_000_000):
        ways = substring_dedup.levels(needed)
        assert needed <= math.prod(ways) <= 2 * needed + 1 and max(ways) <= substring_dedup.FAN and len(ways) <= 3
        assert substring_dedup.by_range(0, s[::5], s, s[::5], s, ways).num_rows == ways[0]


def test_repeat_in_one_text(spark, no_docs):
    once = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"{once} x {once}"), (2, "a " * 40), (3, "b " * 35)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.drop_repeats(df).collect()}
    assert got == {1: (81, 80), 2: (40, 40), 3: (35, 0)}
    assert substring_dedup.drop_repeats(no_docs).count() == 0


def test_repeats_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {d.doc_id: (n, m, hashlib.sha256(k.encode()).hexdigest()) for d, (n, m, k) in zip(docs, brute([d.text for d in docs], 35), strict=True)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op6_substring_dedup(spark, sf_dir).collect()} == want


def shingles(text, n=5):
    import regex

    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if x]
    return {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("most", [100_000, 0])
def test_contained_items(spark, odd_docs, odd_rows, no_docs, most, monkeypatch):
    """Sketches broadcast, and joined by shuffle as for a large benchmark."""
    monkeypatch.setattr(decontamination, "MOST_ITEMS", most)
    long_item = " ".join(f"k{i}" for i in range(300))
    items = [(1, "one, two! THREE"), (2, " ".join((odd_rows[13][1]).split()[58:100])), (3, None), (4, ""), (5, odd_rows[5][1]), (5, odd_rows[5][1]), (6, "nothing like it in any of the texts at all"), (7, long_item)]
    extra = spark.createDataFrame([(900, "start " + " ".join(long_item.split()[:260]) + " end"), (901, " ".join(long_item.split()[:200]))], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(extra)
    got = {(r.doc_id, r.item_id, r.shared) for r in decontamination.find_contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d in docs.collect():
        for i, t in items:
            s = shingles(t)
            both = len(s & shingles(d.text))
            if s and 100 * both >= 80 * len(s):
                want.add((d.doc_id, i, both))
    assert got == want and {(900, 7), (4, 1), (5, 1)} <= {x[:2] for x in want}
    clean = decontamination.drop_contaminated(odd_docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == odd_docs.columns and not {r.doc_id for r in clean.collect()} & {x[0] for x in want}
    assert decontamination.drop_contaminated(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontamination.drop_contaminated(odd_docs, spark.createDataFrame([], "item_id long, text string")).count() == len(odd_rows)


def test_any_column_names(spark):
    names = ["row_key", "row", "item", "gone", "lines", "key", "mark", "_chunk", "chunk", "words", "hash"]
    rows = [(1, "the item is here: one two three four five six", *names), (2, "nothing of it", *names), (None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).withColumn("source", F.lit("a"))
    items = spark.createDataFrame([(None, "one two three four five six"), (4, "quite another one it is")], "item_id long, text string")
    clean = decontamination.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {2, None} and {r.row_key for r in clean.collect()} == {"row_key"}
    assert [(r.doc_id, r.item_id) for r in decontamination.find_contaminated(docs, items).collect()] == [(1, None)]
    assert substring_dedup.drop_repeats(docs).columns == [*docs.columns, "n_words", "n_removed", "kept_text"]
    lines = line_dedup.drop_boilerplate(docs, min_sites=1)
    assert lines.columns == [*docs.columns, "n_lines", "n_removed", "kept_text"] and {r.kept_text for r in lines.collect()} == {""}
    packed = packing.pack_documents(docs.drop("source").withColumn("_tie", F.lit(1)).withColumn("_group", F.lit(1)))
    assert {*names, "_tie", "_group"} <= set(packed.columns) and packed.count() == 3


def test_second_hash_tells_windows_apart():
    h = substring_dedup.word_hashes([b"a", b"b", b"c", b"a", b"b", b"d"])
    for which in (0, 1):
        r = substring_dedup.rolling(h, 2, which)
        assert r[0] == r[3] and len(set(r.tolist())) == 4
    assert not set(substring_dedup.rolling(h, 2, 0).tolist()) & set(substring_dedup.rolling(h, 2, 1).tolist())
