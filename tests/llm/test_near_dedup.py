import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from quirework.llm import common, near_dedup


def words(t):
    return (t or "").encode().lower().split()


def brute(rows, size, percent):
    """Smallest doc_id of each component, on shingle tuples."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count = Counter(g for s in sets.values() for g in s)
    index = defaultdict(list)
    for i, s in sorted(sets.items()):
        order = sorted(s, key=lambda g: (count[g], g))
        near = set()
        for g in order[: len(s) - math.ceil(len(s) * percent / 100) + 1] if s else []:
            near.update(index[g])
            index[g].append(i)
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def near_copies(rng, n, edits):
    base = [f"t{rng.randint(0, 900)}" for _ in range(200)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 9999)}"
        out.append(" ".join(w))
    return out


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = near_dedup.find_near_copies(odd_docs.select("doc_id", "text"), 4, 80).collect()
    assert len(got) == len(odd_rows)
    rows = {r[0]: r[1] for r in odd_rows if r[0] is not None}
    want, _ = brute(list(rows.items()), 4, 80)
    assert all(r.component_id == want.get(r.doc_id) for r in got)
    kept = near_dedup.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("text LIKE 'the same%'").count() == 1
    assert kept.where("doc_id IS NULL").count() == 1 and kept.where("doc_id IN (1, 2, 3)").count() == 3
    assert near_dedup.find_near_copies(no_docs.select("doc_id", "text")).count() == 0


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    rows = [(1, "a b c d e f g h"), (1, "z y x w v u t s"), (0, "z y x w v u t s"), (3, "q w e r t y u i"), (3, "Q w e r t y u i"), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.find_near_copies(docs, 4, 80).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(0, 0, True), (1, 0, False), (1, 1, True), (3, 3, True), (3, 3, True), (3, 3, True), (3, 3, True)]
    kept = sorted((r.doc_id, (r.text or "").lower()) for r in near_dedup.drop_near_copies(docs).collect())
    assert kept == [(0, "z y x w v u t s"), (1, "a b c d e f g h"), (3, ""), (3, ""), (3, "q w e r t y u i")]


def without_a_centre(rng, members):
    """Near copies whose base is not among them: some linked, some just not, with shingles of few and of many holders."""
    base = [f"t{members}x{rng.randint(0, 900)}" for _ in range(150)]
    changes = [(rng.randrange(150), f"c{k}") for k in range(30)]
    for _ in range(members):
        w = list(base)
        for at, word in rng.sample(changes, rng.randint(1, 9)):
            w[at] = word
        yield " ".join(w[: len(w) - rng.choice([0, 0, 10, 25])])


def with_a_passage(rng, holders):
    """Pairs at the threshold inside groups that share a passage."""
    for g in range(6):
        passage = " ".join(f"p{holders}x{g}x{k}" for k in range(80))
        for _ in range(holders):
            yield passage + " " + " ".join(f"o{rng.randint(0, 40)}" for _ in range(rng.choice([6, 8, 9, 10, 12])))


@pytest.mark.parametrize("small", [256, 16, 4])
def test_groups_of_many_kinds(spark, small, monkeypatch):
    """With a low bound for small stars, cores, differences and further rounds of stars find the links."""
    monkeypatch.setattr(near_dedup, "SMALL_STAR", small)
    rng = random.Random(1)
    texts = [t for n in (3, 63, 64, 65, 150) for t in without_a_centre(rng, n)] + [t for n in (2, 10, 11) for t in with_a_passage(rng, n)]
    texts += near_copies(rng, 60, 4) + near_copies(rng, 60, 12) + near_copies(rng, 25, 12) + [f"own words {i} only {i * 7} here {i * 3} now {i}" for i in range(30)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dedup.find_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    want, sizes = brute(rows, 4, 80)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes


def test_a_star_beyond_the_bound(spark):
    rng = random.Random(8)
    rows = list(enumerate([*without_a_centre(rng, 320), *near_copies(rng, 300, 6)]))
    got = near_dedup.find_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    want, _ = brute(rows, 4, 80)
    assert {r.doc_id: r.component_id for r in got} == want


def test_links_the_core_alone_makes():
    """Against all pairs of (held, n): whether a node may be linked by core shingles alone."""
    rng = random.Random(5)
    for _ in range(300):
        nodes = [(h := rng.randint(60, 100), h + rng.randint(0, 20), rng.random() < 0.5) for _ in range(rng.randint(1, 8))]
        sizes = [{"held": h, "least": min(n for x, n, _ in nodes if x == h), "least_open": min((n for x, n, o in nodes if x == h and o), default=None)} for h in {x[0] for x in nodes}]
        limits = near_dedup.room(sizes, 80)
        for i, (h, n, o) in enumerate(nodes):
            if any(180 * min(h, g) >= 80 * (n + m) and (o or p) for j, (g, m, p) in enumerate(nodes) if j != i):
                assert near_dedup.may_share_core(h, n, o, limits, 80)


def test_extra_columns_of_any_name(spark):
    names = ["_words_hash", "kept", "component_id", "bucket", "star", "id", "words_hash", "_share", "gone"]
    rows = [(1, "a b c d e f g h", *names), (2, "a b c d e f g h", *names), (2, "other words are here to be found", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(7, 9)], "a long, b long")
    got = {r.id: r.component for r in near_dedup.components(links).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {7: 7, 9: 7}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, _ = brute(docs, 4, 80)
    assert {r.doc_id: r.component_id for r in near_dedup.op9_near_dedup(spark, sf_dir).collect()} == want


def test_texts_of_stars_are_not_stored_as_sets(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randint(0, 999)) for _ in range(4000)) for _ in range(6)]
    docs = spark.createDataFrame([(10 * i + k, f"{t} end{k}") for i, t in enumerate(texts) for k in range(4)], "doc_id long, text string")
    folder = f"{common.shared_folder(spark)}/quirework-{spark.sparkContext.applicationId}"

    def stored():
        return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))

    before = stored()
    assert near_dedup.find_near_copies(docs, 5, 80).where("kept").count() == 6
    assert stored() - before < 0.3 * docs.selectExpr("sum(octet_length(text))").first()[0]


def test_packed_words():
    words = near_dedup.words_of("One two  THREE\tone two three é " * 50)
    packed = near_dedup.pack(words)
    assert len(packed) < len(b" ".join(words)) / 2
    assert (near_dedup.unpack(packed, 5) == near_dedup.shingle_set(words, 5)).all()
