import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import pii, toxicity


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-1 2+9(5%é😀", max_size=60))
def test_seeds_on_any_text(t):
    assert pii.base_spans(t) == plain_spans(t)


@pytest.mark.parametrize("t", ["card 4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (017) 555-7713 x+12345", "0001.002.3.255 256.1.1.1 1.2.3.4.5.6.7.8", "a@b.c@d.e f@g .x@y.zz", "1" * 3000 + ".1.1.1", "@" * 50 + "a@b-.c"])
def test_seeds(t):
    assert pii.base_spans(t) == plain_spans(t)


def test_contexts_discover_identifiers(spark, no_docs):
    rows = [(i, f"please contact agent on {('+1 017 555 %04d' % i) if i % 2 else ('u%d@mail.example.com' % i)} before noon today") for i in range(40)]
    rows += [(100, "please contact agent on AB-99871x before noon today"), (101, "release notes for version 2024a are out, nothing else here"), (102, None), (103, "")]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s.kind for s in got[100]] == ["id"]
    assert rows[40][1][got[100][0].start : got[100][0].end] == "AB-99871x"
    assert got[101] == got[102] == got[103] == []
    for i, t in rows[:40]:
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in got[i]] == plain_spans(t)
    assert pii.find_personal_data(no_docs.select("doc_id", "text")).count() == 0


def test_pii_query(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest holds no secrets
    """Base spans and their digest by plain patterns; what the method adds are the secrets of one context, all of them."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    added = 0
    for r in pii.op7_personal_data(spark, sf_dir).collect():
        want = plain_spans(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        base = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        secrets = [f"id:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'token = "([0-9a-f]{40})"', docs[r.doc_id])]
        assert sorted(r.spans.split(",") if r.spans else []) == sorted(base + secrets) and r.n_id == len(secrets)
        added += len(secrets)
    assert added >= 3


def test_pii_of_odd_rows(spark, odd_docs, odd_rows):
    got = pii.find_personal_data(odd_docs).collect()
    assert sorted((r.doc_id or -1) for r in got) == sorted((r[0] or -1) for r in odd_rows)
    long_word = "y" * 500
    t = f"one {long_word} two 1.2.3.4 {long_word} three"
    assert pii.contexts(t, t.index("1.2"), t.index("1.2") + 7) == [f"b {long_word} two", f"m two {long_word}", f"a {long_word} three"]
    assert [m["instance"] for m in pii.mentions("user = alice, plain words: bob and 1.2.3.4567")] == ["alice", "bob", "1.2.3.4567"]


def test_gradient():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vocabulary, at = ["idiot", "the", "réeuxpa", "a"], np.array([[0, 1, 2], [1, -1, 3], [2, -1, 0]])
    y, w, rng = np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5]), np.random.default_rng(0)
    _, g = net.gradient(vocabulary, at, y, w)
    for k, v in net.p.items():
        places = np.argwhere(np.abs(g[k]) > 1e-3)
        for place in map(tuple, places[rng.permutation(len(places))[:2]]):
            old, side = v[place], []
            for d in (1e-2, -1e-2):
                v[place] = old + d
                side.append(net.gradient(vocabulary, at, y, w)[0])
            v[place] = old
            assert (side[0] - side[1]) / 2e-2 == pytest.approx(g[k][place], rel=0.05, abs=1e-3)


def test_windows_cover():
    for n in (0, 1, 47, 48, 49, 72, 500):
        starts = toxicity.window_starts(n)
        assert set(range(n)) <= {i for s in starts for i in range(s, s + toxicity.WINDOW)}


def test_scores(spark, odd_docs, odd_rows, no_docs):
    rng = np.random.default_rng(5)
    bad = ["vile", "wretch", "scoundrel"]
    rows = []
    for i in range(300):
        w = [f"w{rng.integers(60)}" for _ in range(rng.integers(5, 120))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                w.insert(int(rng.integers(len(w))), bad[rng.integers(3)])
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = toxicity.with_scores(docs, model).collect()
    out = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= 0.7) == bool(r.toxic) for r in out) >= 0.95 * len(out)
    odd = toxicity.with_scores(odd_docs, model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)
    # a long text is scored to its end
    long = spark.createDataFrame([(1, "w1 w2 w3 " * 3000 + "vile wretch scoundrel"), (2, "w1 w2 w3 " * 3000)], "doc_id long, text string")
    tail = {r.doc_id: r.score for r in toxicity.with_scores(long, model).collect()}
    assert tail[1] > 0.7 > tail[2]
    assert toxicity.with_scores(no_docs, model).count() == 0
    none = toxicity.learn(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none is None and {r.score for r in toxicity.with_scores(odd_docs, none).collect()} == {0.5}


def test_toxicity_query(spark, sf_dir):
    """Every row against the same network run here, window by window."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    net = toxicity.Network()
    net.p = model.params
    want = {}
    for r in docs.collect():
        words = toxicity.words_of(r.text)
        best = -np.inf
        for a in toxicity.window_starts(len(words)):
            w = words[a : a + toxicity.WINDOW]
            x, mask = net.inputs(w), np.ones((len(w), 1), np.float32)
            states = np.concatenate([net.run((x @ net.p[f"W{s}"] + net.p[f"c{s}"])[:, None], s, mask) for s in "fb"], axis=2) if w else np.zeros((1, 1, 2 * toxicity.HIDDEN), np.float32)
            best = max(best, float(net.pool(states, mask if w else np.zeros((1, 1), np.float32))[0][0]))
        want[r.doc_id] = 1 / (1 + np.exp(-best))
    got = toxicity.op8_toxicity(spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(want)
    for r in got.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-4) and r.predicted == int(r.score >= 0.7)


def test_sample_is_bounded_and_of_short_rows(spark):
    rows = [(i, "x " * 5000 if i % 2 else f"word{i} and more", i % 4 // 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), most_toxic=7, most_clean=9, longest=100) is not None
    assert toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), most_toxic=7, most_clean=9, longest=5) is None
    clash = docs.withColumn("score", docs["toxic"])
    assert toxicity.drop_toxic(clash, docs.select("doc_id", "toxic")).columns == clash.columns
