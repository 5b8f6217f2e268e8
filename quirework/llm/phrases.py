"""Phrase collocations by vertical partitioning of truncated suffix trees.

Texts are split into pieces and words. The tree of a language holds the suffixes of all pieces, cut after three words
(the longest phrase). Nobody builds it whole: it grows by a level a round, and a round deepens only what can still
become a candidate. In a round the suffixes, cut at its depth, are grouped by their first word. A word whose suffixes
would pass the memory budget is lengthened to prefixes of two words, such a pair to three; prefixes are dealt to as many
groups as there are budgets of suffixes. A group's subtree is built by one task on its own: the suffixes arrive as
leaves with their numbers (tasks add up equal ones before sending), in order, and a phrase's frequency is the total of
its leaf. The next round leaves out suffixes whose words, or whose first or last two words, were too rare; tasks know
these from a bit filter of the frequent ones, of a bounded size. It may let rare ones pass, never drop a frequent one.

Nodes of two and three words that are frequent enough get the frequency of the parts of each cut by joins, in which a
part that many candidates share doesn't meet in one task. The first of each language are found per part, then among
those.

What the driver and every task hold: at most MOST_LENGTHENED prefixes a level (beyond that the budget grows with the
corpus), and filters of 2**FILTER_BITS bits at most (16 MB).

Rules: a null text is an empty one, a null lang is `und`. Texts without words, empty tables and languages without
candidates give no row. A long text is read whole. Repeated rows and repeated ids count each; only text and lang are
read, other columns play no part. Ties in rank go by score, then a, then phrase.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.common import attach_groups, by_bytes, cut, table, written

#: A-Z in lower case; what ends a piece becomes a byte that UTF-8 doesn't have; a tab is a blank.
CODES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\xff" * 10 + b" ")
MOST_LENGTHENED = 20_000
FILTER_BITS = 27
#: Words that a task codes before it hands their numbers on.
HELD = 4_000_000
Coded = tuple[str, list[bytes], np.ndarray]


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[Coded]:
    """Per language (several times, if there is much text) its words and the texts as their numbers, -1 where a piece ends."""
    numbers: dict[str, defaultdict] = {}
    held: dict[str, list[np.ndarray]] = {}

    def out() -> Iterator[Coded]:
        for lang, parts in held.items():
            yield lang, list(numbers[lang])[1:], np.concatenate(parts) - 1
        held.clear()
        numbers.clear()

    for whole in batches:
        for b in by_bytes(whole, "text", rows=5000, size=8 << 20):
            for lang in b.column("lang").unique().to_pylist():
                some = b.column("text").filter(pc.equal(b.column("lang"), lang)).cast(pa.binary())
                if lang not in numbers:
                    numbers[lang] = defaultdict()
                    numbers[lang].default_factory = numbers[lang].__len__
                    numbers[lang][b"\xff"]
                words = b"\n".join([*some.to_pylist(), b""]).translate(CODES).replace(b"\xff", b" \xff ").split()
                held.setdefault(lang, []).append(np.fromiter(map(numbers[lang].__getitem__, words), np.int64, len(words)))
            if sum(len(x) for parts in held.values() for x in parts) > HELD:
                yield from out()
    yield from out()


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)


def joined_hashes(*parts: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their words."""
    out = np.zeros(len(parts[0]), np.uint64)
    for h in parts:
        out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Filter:
    """A Bloom filter of word or phrase hashes."""

    def __init__(self, bits: int, data: np.ndarray) -> None:
        self.bits, self.data = bits, data

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        return [(hashes >> np.uint64(k)) & np.uint64((1 << bits) - 1) for k in (0, 13, 27)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes, self.bits):
            out &= (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def known_filter(keys: DataFrame, most_bits: int = FILTER_BITS) -> Filter:
    """A filter of phrases (column key: lang, a line end, words with blanks between), built block by block in tasks."""
    bits = min(most_bits, max(13, (keys.count() * 16).bit_length()))
    n_blocks = 1 << max(0, bits - 20)
    size = (1 << bits) // n_blocks // 8

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = np.array([key_hash(k) for k in b.column(0).to_pylist()], dtype=np.uint64)
            at = np.concatenate(Filter.places(hashes, bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // (size * 8)), pa.array(at % (size * 8))], ["block", "place"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            of, at = (b.column(c).to_numpy() for c in ("block", "place"))
            for k in np.unique(of):
                data = held.setdefault(int(k), np.zeros(size, np.uint8))
                mine = at[of == k]
                np.bitwise_or.at(data, mine >> 3, np.left_shift(1, mine & 7).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([d.tobytes() for d in held.values()])], ["block", "data"])

    data = np.zeros((1 << bits) // 8, np.uint8)
    for r in keys.select("key").mapInArrow(places, "block long, place long").repartition(n_blocks, "block").mapInArrow(blocks, "block long, data binary").collect():
        data[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["data"], np.uint8)
    return Filter(bits, data)


def key_hash(key: str) -> int:
    lang, _, words = key.rpartition("\n")
    h = word_hashes(lang, words.encode().split(b" "))
    return int(h[0] if len(h) == 1 else joined_hashes(*h[:, None])[0])


def leaves_of(depth: int, rare: Filter | None, long: list[set[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's suffixes cut at the depth: key, dealt (a hash of the prefix) and their number, without those that hold too rare a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids in coded(batches):
            n, spelled = len(words), pa.array(words, pa.binary())
            if not n:
                continue
            at = [ids[k : len(ids) - depth + 1 + k] for k in range(depth)]
            whole = np.logical_and.reduce([x >= 0 for x in at])
            if depth > 1:
                h = word_hashes(lang, words)
            if depth == 2 and rare is not None:
                frequent = rare.has(h)
                whole &= frequent[at[0]] & frequent[at[1]]
            if depth == 3 and rare is not None:
                pairs = rare.has(joined_hashes(h[ids[:-1]], h[ids[1:]]))
                whole &= pairs[:-1] & pairs[1:]
            # the first two words are numbered anew where three of them would pass 63 bits
            code = at[0][whole]
            back = None
            if depth > 1:
                code = code * n + at[1][whole]
            if depth > 2:
                back, code = np.unique(code, return_inverse=True)
                code = code * n + at[2][whole]
            found, f = np.unique(code, return_counts=True)
            split = [found]
            if depth > 1:
                split = [found // n, found % n]
            if depth > 2:
                first = back[split[0]]
                split = [first // n, first % n, split[1]]
            for k in range(0, len(found), 50_000):
                some = [x[k : k + 50_000] for x in split]
                spell = [spelled.take(pa.array(x)) for x in some]
                prefixes = [pc.binary_join_element_wise(lang.encode() + b"\n", spell[0], b"")]
                for word in spell[1:]:
                    prefixes.append(pc.binary_join_element_wise(prefixes[-1], word, b" "))
                if depth == 1:
                    dealt = np.zeros(len(some[0]), np.int64)
                else:
                    dealt = h[some[0]]
                    for level in range(1, depth):
                        if long[level - 1]:
                            deeper = pc.is_in(prefixes[level - 1], pa.array([x.encode() for x in long[level - 1]], pa.binary())).to_numpy(zero_copy_only=False)
                            dealt = np.where(deeper, joined_hashes(*[h[x] for x in some[: level + 1]]), dealt)
                    dealt = dealt.astype(np.int64)
                yield pa.RecordBatch.from_arrays([prefixes[-1].cast(pa.string()), pa.array(dealt), pa.array(f[k : k + 50_000], pa.int64())], ["key", "dealt", "f"])

    return run


def subtrees(leaves: DataFrame, groups: int, least: int) -> DataFrame:
    """key, a: the leaf totals of each group's subtree, where they reach the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, so_far = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            key, f = b.column("key"), b.column("f").to_numpy()
            changes = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], changes]))
            totals = np.add.reduceat(f, starts)
            names = key.take(pa.array(starts))
            if names[0].as_py() == last:
                totals[0] += so_far
            elif so_far >= least:
                yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([so_far], pa.int64())], ["key", "a"])
            last, so_far = names[-1].as_py(), int(totals[-1])
            done = pa.array(np.flatnonzero(totals[:-1] >= least))
            yield pa.RecordBatch.from_arrays([names.take(done), pa.array(totals).take(done)], ["key", "a"])
        if so_far >= least:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([so_far], pa.int64())], ["key", "a"])

    dealt = leaves.repartition(groups, "dealt").select("key", "f").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key string, a long")


def spelled(nodes: DataFrame, depth: int) -> DataFrame:
    """lang, w1, ..., a from keys."""
    words = F.split(F.substring_index("key", "\n", -1), " ")
    lang = F.expr("left(key, length(key) - length(substring_index(key, '\n', -1)) - 1)")
    return nodes.select(lang.alias("lang"), *[F.get(words, k).alias(f"w{k + 1}") for k in range(depth)], "a")


def with_frequency(rows: DataFrame, known: DataFrame, words: list[str], known_words: list[str], name: str) -> DataFrame:
    """rows (which carry lang) with the frequency of some of their words, looked up among the known nodes."""

    def key(names: list[str]) -> Column:
        return F.struct("lang", *[F.col(w).alias(f"w{i}") for i, w in enumerate(names)])

    keyed = cut(rows.withColumn("key", key(words)))
    asked = keyed.groupBy("key").agg(F.count("*").alias("asked"))
    facts = known.select(key(known_words).alias("key"), F.col("a").alias(name))
    groups = asked.join(facts, "key")
    # no language is null, so this key matches nothing
    other = F.struct(F.lit(None).cast("string").alias("lang"), *[F.xxhash64(F.col("w1"), F.col("w2"), F.col("w3")).cast("string").alias(f"w{i}") for i in range(len(words))])
    return attach_groups(keyed, groups, "key", "asked", keyed.count(), other).drop("key", "asked")


LEAF = "key string, dealt long, f long"


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact up to 38 digits."""
    return F.expr(f"CAST((CAST(1000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0))) DIV (CAST({left} AS DECIMAL(15,0)) * CAST({right} AS DECIMAL(15,0))) AS LONG)")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, first: int = 2000, budget: int = 500_000, groups: int | None = None) -> DataFrame:
    """Each language's first phrases of two and three words: lang, rank, phrase, a, l, r, n, score."""
    docs = texts(docs)
    words = written(docs.mapInArrow(leaves_of(1, None, []), LEAF).groupBy("key").agg(F.sum("f").alias("a")), "phrases-words")
    totals = spelled(words, 1).groupBy("lang").agg(F.sum("a").alias("n"))
    total = words.agg(F.sum("a")).first()[0] or 0
    # a prefix above the limit is lengthened: fewer than MOST_LENGTHENED can be
    limit = max(budget, total // MOST_LENGTHENED)
    groups = groups or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // limit))
    frequent, long = words.where(F.col("a") >= least), []
    nodes = []
    for depth in (2, 3):
        long.append({r["key"] for r in frequent.where(F.col("a") > limit).select("key").collect()})
        leaves = docs.mapInArrow(leaves_of(depth, known_filter(frequent), long), LEAF)
        frequent = written(subtrees(leaves, groups, least), f"phrases-{depth}")
        nodes.append(spelled(frequent, depth))

    unigrams = spelled(words.where(F.col("a") >= least), 1)
    pairs, triples = nodes[0].withColumn("w3", F.lit(None).cast("string")), nodes[1]
    # a candidate that a longer one mostly stands for
    longer = triples.select("lang", "w1", "w2", F.col("a").alias("longer")).union(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("a").alias("longer")))
    longer = longer.groupBy("lang", "w1", "w2").agg(F.max("longer").alias("longer"))
    kept = pairs.join(longer, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).drop("longer")

    two = with_frequency(with_frequency(kept, unigrams, ["w1"], ["w1"], "l1"), unigrams, ["w2"], ["w1"], "r1")
    two = two.withColumns({"s1": score("a", "l1", "r1"), "l": F.col("l1"), "r": F.col("r1")}).select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", F.col("s1").alias("score"))
    three = with_frequency(with_frequency(triples, unigrams, ["w1"], ["w1"], "l1"), unigrams, ["w3"], ["w1"], "r2")
    three = with_frequency(with_frequency(three, pairs, ["w1", "w2"], ["w1", "w2"], "l2"), pairs, ["w2", "w3"], ["w1", "w2"], "r1")
    three = three.withColumns({"s1": score("a", "l1", "r1"), "s2": score("a", "l2", "r2")})
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = two.union(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op11_phrases": op11_phrases}
ORACLES = {
    "op11_phrases": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
             p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
             w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
             s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
             g AS (SELECT lang, w[i:i + k - 1] AS g, k, count(*) AS f FROM s CROSS JOIN (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
             n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
             c AS (SELECT * FROM g WHERE k >= 2 AND f >= 10),
             x AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, g[1:2] AS g, f FROM c WHERE k = 3 UNION ALL SELECT lang, g[2:3], f FROM c WHERE k = 3) GROUP BY ALL),
             k AS (SELECT c.* FROM c LEFT JOIN x ON x.lang = c.lang AND x.g = c.g WHERE x.f IS NULL OR 100 * x.f < 50 * c.f),
             u AS (SELECT lang, g, k, f, unnest(range(1, k)) AS place FROM k),
             j AS (SELECT u.*, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * u.f * u.f) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
                   FROM u JOIN g l ON l.lang = u.lang AND l.g = u.g[1:place] JOIN g r ON r.lang = u.lang AND r.g = u.g[place + 1:u.k]),
             b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, place) = 1),
             z AS (SELECT *, array_to_string(g, ' ') AS phrase FROM b)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, encode(phrase)) AS rank, phrase, f AS a, l, r, n, score
        FROM z JOIN n USING (lang) QUALIFY rank <= 2000"""
}
