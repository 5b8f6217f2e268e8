r"""Repeated passages, by fixed-block anchors.

A passage of `window` words that stands in two places holds, in each of them, a whole block of the reference grid:
blocks of (window + 1) / 2 words that follow one another without overlap from a document's first word.

1. Index and probe: the grid's blocks are the reference index; every rolling window of a block's length, at any
   word, probes it. A block that is hit from any place but its own is an anchor.
2. Extend: around each anchor, every window of `window` words that holds it is tried. One whose word sequence starts
   anywhere else is repeated; runs of repeated windows are the maximal exact repeats. Their words are removed.

Documents are dealt by a hash into chunks of about the same size. What a chunk sends is, for each range of hash
values, the sorted list of its distinct hashes (one that it holds twice is sent twice), as differences. What it gets back
are those of its hashes that are repeated. So a passage that a third of all documents share costs each chunk two
entries, and no pairs are ever made. Chunks and ranges keep their sizes, so both grow in number with the corpus; a chunk
doesn't send to every range, though, but to FAN groups of ranges, where what FAN chunks sent is put together and sent on, as
FAN rows again, until a row is of one range: one hop up to 3 GB of text, two up to 800 GB, three up to 200 TB. Lists
take two to three bytes a word in the first hop, for 40-bit probes (five for 64-bit ones at 100 TB), and eight more
for whose they are in later ones. Probes have 20
bits more than the number of words has (40 at least), so one block in a million is an anchor by chance, which costs a
few tries. Extension compares 64 bits among the windows of one range, and a second, independent hash chooses the
range: at 100 TB (1.5e13 words, 7e6 ranges) that is 86 bits, and about one window is taken for a repeat by chance.

Rules: words are runs of anything but space and the control characters 9 to 13, unchanged. A null text has none. Texts
shorter than a window are kept. Rows that repeat a text repeat all its windows. Extra columns pass through; they may
have any name but those of the added ones (n_words, n_removed, kept_text). An empty table gives an empty one; a very
long text has all its windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.llm.common import fresh, table
from quirework.llm.near_dedup import MULTIPLIERS, mix

#: Bytes of text in a chunk, and of hashes in a range, about.
CHUNK_BYTES, RANGE_HASHES = 8 << 20, 2 << 20
LEAST_PROBE_BITS = 40

#: How many ways a hop divides hash values, at most.
FAN = 256

SENT = T.StructType([*[T.StructField(n, T.LongType()) for n in ("range", "batch", "chunk")], *[T.StructField(n, T.BinaryType()) for n in ("asks", "whose", "seen", "asks_of", "seen_of")]])
ANSWERED = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("range", T.LongType()), T.StructField("hashes", T.BinaryType())])


@lru_cache(maxsize=4)
def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2**64."""
    m = MULTIPLIERS[which]
    up, down = np.full(n, m, dtype=np.uint64), np.full(n, pow(m, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def rolling(h: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `length` words; `which` chooses one of several."""
    if len(h) < length:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(1 << max(16, (len(h) - 1).bit_length()), which)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return mix((total[length:] - total[:-length]) * down[: len(h) - length + 1])


def squeeze(a: np.ndarray) -> bytes:
    """A sorted list of 64-bit numbers as compressed byte planes of its differences."""
    if not len(a):
        return b""
    d = np.diff(a, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze(b: bytes) -> np.ndarray:
    if not b:
        return np.empty(0, dtype=np.uint64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def twice_at_most(a: np.ndarray) -> np.ndarray:
    """The places of the sorted values, each once or, if there are more, twice."""
    at = np.argsort(a, kind="stable")
    return at if len(a) < 3 else at[np.r_[True, True, a[at[2:]] != a[at[:-2]]]]


def levels(needed: int) -> list[int]:
    """How many ways each hop divides the hash values, FAN at most, for at least so many ranges."""
    n = max(1, math.ceil(math.log(max(needed, 1), FAN) - 1e-9))
    return [max(1, math.ceil(needed ** (1 / n) - 1e-9))] * n


def table_of(rows: list[tuple], schema: T.StructType) -> pa.Table:
    kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64() for f in schema.fields]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)


def slices(digit: np.ndarray) -> dict[int, np.ndarray]:
    """The places of each digit, in order."""
    at = np.argsort(digit, kind="stable")
    found, starts = np.unique(digit[at], return_index=True)
    return dict(zip(found.tolist(), np.split(at, starts[1:]), strict=True)) if len(at) else {}


def by_range(chunk: int, asks: np.ndarray, seen: np.ndarray, a_of: np.ndarray, s_of: np.ndarray, ways: list[int]) -> pa.Table:
    """Rows of SENT, from sorted hashes and what chooses the range of each; a row per way of the first hop at most."""
    ranges, more = math.prod(ways), len(ways) > 1 and a_of is not asks
    width = np.uint64(ranges // ways[0])
    a_at, none = slices(a_of % np.uint64(ranges) // width), np.empty(0, dtype=np.int64)
    rows = []
    for r, at in slices(s_of % np.uint64(ranges) // width).items():
        a = a_at.get(r, none)
        rows.append((r, chunk, chunk, squeeze(asks[a]), None, squeeze(seen[at]), a_of[a].tobytes() if more else None, s_of[at].tobytes() if more else None))
    return table_of(rows, SENT)


def held(part: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """asks, whose they are, seen, and what chooses the ranges of both, of each row."""
    for r in part.to_pylist():
        a, s = unsqueeze(r["asks"]), unsqueeze(r["seen"])
        whose = np.full(len(a), r["chunk"], dtype=np.int64) if r["whose"] is None else np.frombuffer(r["whose"], dtype=np.int64)
        yield a, whose, s, a if r["asks_of"] is None else np.frombuffer(r["asks_of"], dtype=np.uint64), s if r["seen_of"] is None else np.frombuffer(r["seen_of"], dtype=np.uint64)


def next_hop(key: tuple, part: pa.Table, level: int, ways: list[int]) -> pa.Table:
    """What FAN senders have for a range, together, divided further: as many rows as there are ways, whatever the corpus."""
    a, whose, s, a_of, s_of = (np.concatenate(x) for x in zip(*held(part), strict=True))
    at = np.argsort(a, kind="stable")
    a, whose, a_of = a[at], whose[at], a_of[at]
    at = twice_at_most(s)
    s, s_of = s[at], s_of[at]
    more = part.column("asks_of").null_count < part.num_rows
    ranges, width, n = math.prod(ways), np.uint64(math.prod(ways[level + 1 :])), np.uint64(ways[level])
    a_at, none = slices(a_of % np.uint64(ranges) // width % n), np.empty(0, dtype=np.int64)
    rows = []
    for r, places in slices(s_of % np.uint64(ranges) // width % n).items():
        k = a_at.get(r, none)
        rows.append((key[0].as_py() * ways[level] + r, key[1].as_py(), -1, squeeze(a[k]), whose[k].tobytes(), squeeze(s[places]), a_of[k].tobytes() if more else None, s_of[places].tobytes() if more else None))
    return table_of(rows, SENT)


def routed(sent: DataFrame, ways: list[int]) -> DataFrame:
    """Rows of SENT of whole ranges. Each hop moves every hash once; there is one hop more for each FAN-fold corpus."""

    def hop(level: int):
        return lambda key, part: next_hop(key, part, level, ways)

    for level in range(1, len(ways)):
        sent = sent.withColumn("batch", F.floor(F.col("batch") / FAN)).groupBy("range", "batch").applyInArrow(hop(level), SENT)
    return sent


def answer(key: tuple, part: pa.Table) -> pa.Table:
    """For each chunk, those of its hashes that are seen twice or more in all chunks together."""
    seen = np.sort(np.concatenate([unsqueeze(x) for x in part.column("seen").to_pylist()]))
    again = np.unique(seen[1:][seen[1:] == seen[:-1]])
    rows = []
    for a, whose, *_ in held(part.set_column(part.schema.get_field_index("seen"), "seen", pa.array([b""] * part.num_rows, pa.binary()))) if len(again) else []:
        hit = within(a, again)
        for chunk, at in slices(whose[hit]).items():
            rows.append((chunk, key[0].as_py(), squeeze(np.sort(a[hit][at]))))
    return table_of(rows, ANSWERED)


def answers(part: pa.Table) -> np.ndarray:
    got = [unsqueeze(x) for x in part.column("hashes").to_pylist()]
    return np.sort(np.concatenate(got)) if got else np.empty(0, dtype=np.uint64)


def within(a: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_) or not len(a):
        return np.zeros(len(a), dtype=bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, a), len(sorted_) - 1)] == a


def texts(part: pa.Table, text: str) -> list[bytes | None]:
    return part.column(text).cast(pa.binary()).to_pylist()


def drop_repeats(docs: DataFrame, window: int = 35, text: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept_text (words joined by one space)."""
    block = (window + 1) // 2
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, round(size / CHUNK_BYTES))
    ways = levels(max(1, round(size / 6 / RANGE_HASHES)))
    shift = np.uint64(64 - min(64, max(LEAST_PROBE_BITS, math.ceil(math.log2(size / 6 + 1)) + 20)))
    (chunk,) = fresh([*docs.columns, "chunk", "n_words", "n_removed", "kept_text"], "_chunk")
    # all columns of a row choose its chunk, so copies of one text without ids are spread as far as anything tells them apart
    dealt = docs.withColumn(chunk, F.pmod(F.xxhash64(F.lit("chunk"), *[F.col(f"`{c}`") for c in docs.columns]), F.lit(chunks)).cast("long"))
    names = docs.columns

    def anchors(probes: np.ndarray) -> np.ndarray:
        """The hashes of the grid's blocks, as probes have them."""
        return probes[::block]

    def index_and_probe(key: tuple, part: pa.Table) -> pa.Table:
        asks, seen = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.uint64)]
        for t in texts(part, text):
            words = (t or b"").split()
            if len(words) >= window:
                probes = rolling(word_hashes(words), block) >> shift
                asks.append(anchors(probes))
                seen.append(probes)
        a, s = np.unique(np.concatenate(asks)), np.concatenate(seen)
        s = s[twice_at_most(s)]
        return by_range(key[0].as_py(), a, s, a, s, ways)

    def extend(key: tuple, part: pa.Table, found: pa.Table) -> pa.Table:
        hit, tries, others = answers(found), [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.uint64)]
        for t in texts(part, text) if len(hit) else []:
            words = (t or b"").split()
            if len(words) < window:
                continue
            h = word_hashes(words)
            is_anchor = within(anchors(rolling(h, block) >> shift), hit)
            if is_anchor.any():
                w = rolling(h, window)
                first = -(-np.arange(len(w)) // block)  # the first block that starts in the window
                tries.append(w[is_anchor[first]])
                others.append(rolling(h, window, 1)[is_anchor[first]])
        seen, other = np.concatenate(tries), np.concatenate(others)
        at = twice_at_most(seen)
        seen, other = seen[at], other[at]
        once = np.r_[True, seen[1:] != seen[:-1]] if len(seen) else np.zeros(0, dtype=bool)
        return by_range(key[0].as_py(), seen[once], seen, other[once], other, ways)

    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    schema = T.StructType([*docs.schema.fields, *added])

    def remove(key: tuple, part: pa.Table, found: pa.Table) -> pa.Table:
        again = answers(found)
        n_words, n_removed, kept = [], [], []
        for t in texts(part, text):
            words = (t or b"").split()
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            if len(again) and len(words) >= window:
                starts = np.flatnonzero(within(rolling(word_hashes(words), window), again))
                gone[starts] += 1
                np.add.at(gone, starts + window, -1)
            covered = np.cumsum(gone)[:-1] > 0
            removed = int(covered.sum())
            n_words.append(len(words))
            n_removed.append(removed)
            kept.append(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c] if removed else words))
        out = part.select(names)
        for name, a in (("n_words", pa.array(n_words, pa.int64())), ("n_removed", pa.array(n_removed, pa.int64())), ("kept_text", pa.array(kept, pa.binary()).cast(pa.string()))):
            out = out.append_column(name, a)
        return out

    grouped = dealt.groupBy(chunk)
    sent = grouped.applyInArrow(lambda key, part: index_and_probe(key, part), SENT)
    found = routed(sent, ways).groupBy("range").applyInArrow(lambda key, part: answer(key, part), ANSWERED)
    tried = grouped.cogroup(found.groupBy("chunk")).applyInArrow(lambda key, part, more: extend(key, part, more), SENT)
    again = routed(tried, ways).groupBy("range").applyInArrow(lambda key, part: answer(key, part), ANSWERED)
    return grouped.cogroup(again.groupBy("chunk")).applyInArrow(lambda key, part, more: remove(key, part, more), schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES: dict[str, str] = {}
