import re
from collections import Counter, defaultdict

import duckdb
import pytest

from quirework.llm import phrases


def brute(rows, least, share, first):
    """rows: (lang, text). All counts in dictionaries."""
    freq = defaultdict(Counter)
    for lang, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                freq["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in freq.items():
        cand = {g for g, n in f.items() if len(g) > 1 and n >= least}
        gone = {part for g in cand if len(g) == 3 for part in (g[:2], g[1:]) if 100 * f[g] >= share * f[part]}
        best = []
        for g in cand - gone:
            cuts = [(1000000 * f[g] ** 2 // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            s, k = min(cuts)
            best.append((-s, -f[g], " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        n = sum(c for g, c in f.items() if len(g) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:first])]
    return sorted(out)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("budget", [1, 30, 500_000])
def test_by_brute_force(spark, odd_docs, odd_rows, budget):
    """A budget of 1 lengthens every frequent prefix to three words, 30 some of them."""
    hot = [(500 + i, f"hot pair w{i % 7} hot pair\x01 {'a b' if i % 3 else 'A  B c'} hot\tpair, hot pair: of it; a\x0b of it a", "en" if i % 2 else None, "s", 1, 1) for i in range(90)]
    docs = odd_docs.union(spark.createDataFrame(hot, odd_docs.schema)).withColumnsRenamed({"kept_extra": "w1", "source": "phrase"})
    want = brute([(r[2], r[1]) for r in [*odd_rows, *hot]], 3, 50, 40)
    assert len(want) > 40
    assert got(phrases.collocations(docs, least=3, first=40, budget=budget, groups=5)) == want


def test_nothing(spark, no_docs, odd_docs):
    assert phrases.collocations(no_docs).count() == 0
    assert phrases.collocations(odd_docs.where("doc_id IN (1, 2, 3, 4)")).count() == 0


def test_query(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(phrases.ORACLES["op11_phrases"])
    rows = sorted(want.select("lang, rank, phrase, a, l, r, n, score").fetchall())
    assert rows and got(phrases.op11_phrases(spark, sf_dir)) == rows
    assert rows == brute([(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()], 10, 50, 2000)
