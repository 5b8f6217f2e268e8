"""Near duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges.

1. Each text becomes its set of distinct word shingles (64-bit hashes of lower-cased words). Texts of equal words are
   one class, a node of the graph, so a large group of copies costs one node.
2. One hash per shingle deals the set over `bins` bins; each bin keeps its minimum. An empty bin borrows from a bin
   that a hash of (bin, attempt) names, again and again until that one is not empty (optimal densification: each
   empty bin chooses on its own). Bands of `rows` bins are the buckets.
3. A bucket belongs to the star of its member with the most bucket mates; as a cluster shares that member, most of its
   buckets fall into one star. Two nodes of a bucket are in one star. A star of n nodes gives n - 1 candidate edges, all
   to its centre.
4. The edges a star lacks are found by what nodes differ in. Let C be the star's core (the shingles that most of a few
   members hold); D is what a node lacks of C, A what it has beyond. For nodes u and v,

       |u & v| = |C| - |Du| - |Dv| + |Du & Dv| + |Au & Av|.

   With f(u) = (100 + percent) |Du| + percent |u|, nodes that share no element of A or D are linked just if
   f(u) + f(v) <= (100 + percent) |C|. The centre is the node with the smallest f; if that sum holds for u and v, it
   holds for u and the centre and for v and the centre. So such links never need an edge of their own. All other
   links share a difference, and by the prefix principle one of a few: of the first (100 - percent) % of A, or, if
   they share none of A, of the first |D| - t + 1 of D, where t is how far f(u) + f(centre) lies above the bound. D
   counts only where sizes leave a link possible: |u & v| is then |C & u & v|, at most the smaller of |C & u| and
   |C & v|. Nodes that share such a difference are a star of the next round, unless all are linked with the centre;
   it is at most about half as large, as the core holds what most have. Rounds end when no star is left. So no link
   inside a bucket is lost, without trying all its pairs.
5. A star of at most SMALL_STAR nodes (and SMALL_SIZE shingles) needs no rounds: one task holds its full sets and
   compares them, but for nodes that sizes and signatures leave no partner. Both ways find the same links. Between tasks
   go compressed words, a third of the size of a set, which each task makes of them anew.
6. All counts are on full sets, so each link is exact. Links are joined to components.

Rules: a null or wordless text has an empty set and no link. A text with fewer words than a shingle has its word
sequence as its one shingle. A row with a null doc_id is linked with nothing and kept. Rows that repeat a doc_id are
documents of their own; of a group, one row stays: one whose doc_id is the smallest. Extra columns of any name pass
through drop_near_copies(). An empty table gives an empty one; a very long text has all its shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.llm.common import attach_groups, attach_large, by_bytes, cut, fresh, release, small_batches, table, written

BINS, ROWS = 150, 5
#: Signatures of pairs at the threshold agree in 80 % of the bins, give or take 3.3 % (4.1 % for small sets), so of
#: those about one in 2 million is this low at worst.
LEAST_AGREEMENT = 0.6
#: Nodes and shingles of a star that one task compares.
SMALL_STAR, SMALL_SIZE = 256, 1 << 22
#: Members of a star whose common shingles are its core, about. They only steer the search; links don't depend on them.
CORE_MEMBERS = 15
#: A set of ids below this number is broadcast (16 MB at most); larger ones are joined by shuffle.
SMALL_IDS = 1_000_000
#: Odd multipliers for the words of a shingle; those of the generators in Knuth, L'Ecuyer and Vigna.
MULTIPLIERS = [6364136223846793005, 3935559000370003845, 2862933555777941757, 7664345821815920749, 3202034522624059733, 4768777513237032717, 1181783497276652981, 2685821657736338717]


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and the control characters 9 to 13, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `size` words."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - size + 1)
    total = np.full(n, len(words) if len(words) < size else size, dtype=np.uint64)
    for j in range(min(size, len(words))):
        total += h[j : j + n] * np.uint64(MULTIPLIERS[j])
    return np.unique(mix(total))


def donors(bins: int, attempts: int) -> np.ndarray:
    """donors[a, b]: the bin from which bin b tries to borrow at attempt a."""
    a, b = np.meshgrid(np.arange(attempts, dtype=np.uint64), np.arange(bins, dtype=np.uint64), indexing="ij")
    return (mix(a * np.uint64(1 << 32) + b + np.uint64(1)) % np.uint64(bins)).astype(np.int64)


def signature(shingles: np.ndarray, bins: int, table_: np.ndarray) -> np.ndarray:
    """The densified minima of a set that isn't empty."""
    bin_of = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]])  # sorted by bin and value, as the set is sorted
    sig = np.zeros(bins, dtype=np.uint64)
    full = np.zeros(bins, dtype=bool)
    at = bin_of[first].astype(np.int64)
    sig[at], full[at] = shingles[first], True
    empty = np.flatnonzero(~full)
    for row in table_:
        if not len(empty):
            break
        from_ = row[empty]
        ok = full[from_]
        sig[empty[ok]] = sig[from_[ok]]
        empty = empty[~ok]
    if len(empty):  # as good as never: the first full bin clockwise
        full_at = np.flatnonzero(full)
        sig[empty] = sig[full_at[np.searchsorted(full_at, empty) % len(full_at)]]
    return mix(sig)


def pack(words: list[bytes]) -> bytes:
    """The words, compressed, after their length; unpack() makes the set of them."""
    text = b" ".join(words)
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unpack(packed: bytes, size: int) -> np.ndarray:
    text = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    return shingle_set(text.split(), size)


FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("words_hash", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def features(docs: DataFrame, size: int, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """doc_id, hash of the words, size of the set and bucket ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borrow = donors(bins, 64 * 8)
        power = np.asarray([pow(MULTIPLIERS[0], k + 1, 1 << 64) for k in range(rows)], dtype=np.uint64)
        band_no = np.arange(bins // rows, dtype=np.uint64) * np.uint64(MULTIPLIERS[1])
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            hashes, sizes, bands = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                s = shingle_set(words, size)
                sizes.append(len(s))
                hashes.append(words_hash(words))
                bands.append(mix((signature(s, bins, borrow).reshape(-1, rows) * power).sum(axis=1, dtype=np.uint64) + band_no).view(np.int64) if words else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hashes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=FEATURES.names)
        release()

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FEATURES)


def words_hash(words: list[bytes]) -> bytes | None:
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids (which is stored); few ids are broadcast, many are shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() < SMALL_IDS else ids, key, "left_semi")


def class_rows(docs: DataFrame, classes: DataFrame, columns: str, make: Callable[[list[bytes]], tuple]) -> DataFrame:
    """words_hash and the columns that make() gives of the words, of each class (words_hash, smallest; stored).

    They come from the texts of the classes' smallest doc_ids. If these are many, all texts are gone through rather than
    shuffled by doc_id; so what is shuffled, by words_hash, are the columns alone.
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            words = [w for w in (words_of(t.as_py()) for t in batch.column("text")) if w]
            made = list(zip(*map(make, words), strict=True)) or [[] for _ in names]
            kinds = [pa.int64() if c.endswith(" long") else pa.binary() for c in columns.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(map(words_hash, words), pa.binary()), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=["words_hash", *names])
        release()

    few = classes.count() < SMALL_IDS
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), "text")
    rows = rows.join(F.broadcast(classes.select(F.col("smallest").alias("doc_id"))), "doc_id", "left_semi") if few else rows.where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, f"words_hash binary, {columns}").dropDuplicates(["words_hash"])


def class_signatures(docs: DataFrame, classes: DataFrame, size: int, bins: int = BINS) -> DataFrame:
    """id, size n of the set and signature (16 bits a bin) of each class (id, words_hash, smallest)."""
    borrow = donors(bins, 64 * 8)

    def make(words: list[bytes]) -> tuple:
        s = shingle_set(words, size)
        return len(s), signature(s, bins, borrow).astype("<u2").tobytes()

    hashed = class_rows(docs, classes, "n long, sig binary", make)
    return written(hashed.join(classes.select("id", "words_hash"), "words_hash").select("id", "n", "sig"), "near-signatures")


def class_words(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """words_hash and packed words of each class (id, words_hash, smallest)."""
    return class_rows(docs, classes, "packed binary", lambda words: (pack(words),))


def first_stars(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """star, id, n, members and weight (of the star) for the nodes of the stored buckets (id, bucket) of two members or more."""
    n = buckets.count()
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("mates")).where("mates > 1")
    held = written(attach_groups(buckets, sizes, "bucket", "mates", n, F.xxhash64("id", "bucket"), how="inner"), "near-buckets")
    ranked = held.join(held.groupBy("id").agg(F.sum("mates").alias("degree")), "id")
    best = ranked.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("top"), F.count("*").alias("size"))
    best = best.select("bucket", "size", (-F.col("top.minus")).alias("star"))
    rows = attach_groups(held.select("id", "bucket"), best, "bucket", "size", n, F.xxhash64("id", "bucket")).select("star", "id").distinct()
    rows = cut(rows.join(classes.select("id", "n"), "id").select("star", "id", "n"))
    sizes = rows.groupBy("star").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
    return written(attach_groups(rows, sizes, "star", "members", rows.count(), F.xxhash64("id", "star"), how="inner"), "near-stars")


def is_small() -> Column:
    return (F.col("members") <= SMALL_STAR) & (F.col("weight") <= SMALL_SIZE)


def cores(stars: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """star, members, core: the shingles that most of about CORE_MEMBERS members hold."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        each = np.concatenate([unpack(x.as_py(), size) for x in part.column("packed")])
        value, count = np.unique(each, return_counts=True)
        core = value[2 * count > part.num_rows]
        return pa.table({"star": pa.array([key[0].as_py()], pa.int64()), "members": part.column("members")[:1], "core": pa.array([core.tobytes()], pa.binary())})

    spread = 1 << 30
    some = stars.where(F.pmod(F.xxhash64("star", "id"), F.lit(spread)) * F.col("members") < CORE_MEMBERS * spread)
    return written(some.join(sets, "id").groupBy("star").applyInArrow(lambda key, part: run(key, part), "star long, members long, core binary"), "near-cores")


def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of a are in b; both sorted."""
    if not len(b):
        return np.zeros(len(a), dtype=bool)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def differences(stars: DataFrame, sets: DataFrame, core: DataFrame, size: int, percent: int) -> DataFrame:
    """Per star and node: its set's size n, how much of the core it holds, f, and the bound that f goes with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 500):
            sizes, held, fs, bounds = [], [], [], []
            for x, c in zip(b.column("packed"), b.column("core"), strict=True):
                s, k = unpack(x.as_py(), size), np.frombuffer(c.as_py() or b"", dtype=np.uint64)
                sizes.append(len(s))
                held.append(int(within(k, s).sum()))
                fs.append((100 + percent) * (len(k) - held[-1]) + percent * len(s))
                bounds.append((100 + percent) * len(k))
            cols = [b.column("star"), b.column("id"), b.column("members"), *(pa.array(x, pa.int64()) for x in (sizes, held, fs, bounds))]
            yield pa.RecordBatch.from_arrays(cols, names=["star", "id", "members", "n", "held", "f", "bound"])

    rows = stars.join(sets, "id").withColumn("salt", F.xxhash64("id"))
    both = attach_large(rows, core, "star", "members", "salt", how="left").select("star", "id", "members", "packed", "core")
    return written(both.mapInArrow(run, "star long, id long, members long, n long, held long, f long, bound long"), "near-differences")


def room(sizes: list[dict], percent: int) -> tuple[np.ndarray, ...]:
    """From the least sizes by number of core shingles held: those numbers, the least size of nodes that hold as many
    or more, and the largest size a partner of nodes that hold as many or fewer may have; of all nodes, then of the
    open ones (which f alone doesn't link with the centre)."""
    none = np.iinfo(np.int64).max // 4
    order = sorted(sizes, key=lambda x: x["held"])
    held = np.asarray([x["held"] for x in order], dtype=np.int64)
    out = [held]
    for k in ("least", "least_open"):
        n = np.asarray([none if x[k] is None else x[k] for x in order], dtype=np.int64)
        out += [np.minimum.accumulate(n[::-1])[::-1], np.maximum.accumulate((100 + percent) * held // percent - n)]
    return tuple(out)


def may_share_core(held: int, n: int, open_: bool, limits: tuple[np.ndarray, ...], percent: int) -> bool:
    """Whether a node that holds so much of the core could be linked by the core alone, one of the two being open."""
    at, least, most = limits[0], *(limits[1:3] if open_ else limits[3:5])
    i = int(np.searchsorted(at, held))
    as_smaller = i < len(at) and least[i] <= (100 + percent) * held // percent - n
    j = int(np.searchsorted(at, held, side="right")) - 1
    return bool(as_smaller or (j >= 0 and most[j] >= n))


def against_centre(diffs: DataFrame, sets: DataFrame, core: DataFrame, size: int, percent: int) -> DataFrame:
    """Per star and node: the centre, whether the node is linked with it, and the differences other links would share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, limits, c = None, None, None
        for b in parts(batches, 200):
            linked, elements = [], []
            for row in b.to_pylist():
                x, k = unpack(row["packed"], size), np.frombuffer(row["core"] or b"", dtype=np.uint64)
                if seen != row["star"]:
                    seen, limits, c = row["star"], room(row["sizes"] or [], percent), unpack(row["c_packed"], size)
                n, held = row["n"], row["held"]
                linked.append((100 + percent) * int(within(x, c).sum()) >= percent * (n + len(c)))
                some = x[~within(x, k)][: n * (100 - percent) // 100 + 1]
                above = row["f"] + row["c_f"] - row["bound"]
                if 100 * held >= percent * n and may_share_core(held, n, above > 0, limits, percent):
                    d = k[~within(k, x)]
                    least = max(1, -(-above // (100 + percent)))
                    some = np.concatenate([some, ~d[: max(0, len(d) - least + 1)]])
                elements.append(some.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("star"), b.column("id"), b.column("n"), b.column("centre"), pa.array(linked, pa.bool_()), pa.array(elements, pa.list_(pa.int64()))], names=["star", "id", "n", "centre", "linked", "elements"])

    centre = diffs.groupBy("star").agg(F.min(F.struct("f", "id")).alias("c"), F.count("*").alias("size")).select("star", "size", F.col("c.f").alias("c_f"), F.col("c.id").alias("centre"))
    centre = cut(centre)
    plain = diffs.select("star", "id", "n", "held", "f", "bound").where(F.col("held") * 100 >= F.col("n") * percent)
    sized = attach_groups(plain, centre, "star", "size", diffs.count(), F.xxhash64("star", "id"), how="inner")
    is_open = F.col("f") + F.col("c_f") > F.col("bound")
    sizes = sized.groupBy("star", "held").agg(F.min("n").alias("least"), F.min(F.when(is_open, F.col("n"))).alias("least_open")).groupBy("star").agg(F.collect_list(F.struct("held", "least", "least_open")).alias("sizes"))
    facts = centre.withColumnRenamed("size", "members").join(sizes, "star", "left").join(core.select("star", "core"), "star", "left")
    facts = written(facts.join(sets.select(F.col("id").alias("centre"), F.col("packed").alias("c_packed")), "centre"), "near-centres")
    rows = diffs.drop("members").join(centre.select("star", F.col("size").alias("members")), "star").join(sets, "id").withColumn("salt", F.xxhash64("id"))
    both = attach_large(rows, facts, "star", "members", "salt").where("id <> centre").drop("salt", "members")
    return written(both.mapInArrow(run, "star long, id long, n long, centre long, linked boolean, elements array<long>"), "near-edges")


def next_stars(edges: DataFrame) -> DataFrame:
    """star, id, n, members, weight: nodes of a star that share a difference, at least one of them not linked with the centre.

    Differences that the same nodes share make one star: its name is made of theirs.
    """
    rows = edges.select("id", "n", "linked", "star", F.explode("elements").alias("element")).select("id", "n", "linked", F.xxhash64("star", "element").alias("shared"))
    groups = rows.groupBy("shared").agg(F.count("*").alias("members"), F.sum("n").alias("weight"), F.min("linked").alias("settled"), F.bit_xor(F.xxhash64("id")).alias("names"))
    groups = groups.where("members > 1 AND NOT settled").select("shared", "members", "weight", F.xxhash64("names", "members").alias("star"))
    total = edges.agg(F.sum(F.size("elements"))).first()[0] or 0
    found = attach_groups(rows.drop("linked"), groups, "shared", "members", total, F.xxhash64("id", "shared"), how="inner")
    return written(found.select("star", "id", "n", "members", "weight").distinct(), "near-stars")


def links_inside(stars: DataFrame, docs: DataFrame, classes: DataFrame, signatures: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: edges that join the linked nodes of each small star."""

    def like(n: np.ndarray) -> np.ndarray:
        return np.minimum(n[:, None], n) * 100 >= np.maximum(n[:, None], n) * percent

    def partners(key: tuple, part: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), dtype="<u2").reshape(part.num_rows, -1)
        ok = like(part.column("n").to_numpy())
        for i in range(len(ok)):
            ok[i] &= (sig == sig[i]).mean(axis=1) >= LEAST_AGREEMENT
            ok[i, i] = False
        return part.select(["star", "id"]).filter(pa.array(ok.any(axis=1)))

    def compare(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        sets_ = [unpack(x.as_py(), size) for x in part.column("packed")]
        ids, head = part.column("id").to_pylist(), list(range(part.num_rows))
        n = np.asarray([len(x) for x in sets_])
        ok, edges = like(n), []
        for i in range(len(ids)):
            for j in range(i):
                if ok[i, j] and head[i] != head[j] and (100 + percent) * int(within(sets_[i], sets_[j]).sum()) >= percent * int(n[i] + n[j]):
                    edges.append((ids[j], ids[i]))
                    old, new = head[i], head[j]
                    head = [new if x == old else x for x in head]
        return pa.table({"a": pa.array([x[0] for x in edges], pa.int64()), "b": pa.array([x[1] for x in edges], pa.int64())})

    ids = cut(stars.select("id").distinct())
    rows = stars.select("star", "id").join(among(signatures, ids, "id"), "id")
    some = written(rows.groupBy("star").applyInArrow(lambda key, part: partners(key, part), "star long, id long"), "near-partners")
    wanted = cut(among(classes.select("id", "words_hash", "smallest"), cut(some.select("id").distinct()), "id"))
    named = some.join(wanted.select("id", "words_hash"), "id")
    held = named.join(class_words(docs, wanted), "words_hash").select("star", "id", "packed")
    return written(held.groupBy("star").applyInArrow(lambda key, part: compare(key, part), "a long, b long").distinct(), "near-inside")


def components(links: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of all ends of the links (a, b).

    Each round every node takes the smallest label of itself and its neighbours, then the label of that label; the
    rounds needed grow with the logarithm of a component's width.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        seen = both.join(labels.toDF("b", "component"), "b").select(F.col("a").alias("id"), "component")
        near = seen.union(labels).groupBy("id").agg(F.min("component").alias("component"))
        jump = near.join(labels.toDF("component", "further"), "component", "left").select("id", F.least("component", "further").alias("component"))
        new = cut(jump)
        moved = new.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        labels = new
        if not moved:
            return labels


def links_of(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: edges of the classes' graph that join all linked classes of a bucket."""
    buckets = written(classes.select("id", F.explode("bands").alias("bucket")), "near-bands")
    stars = first_stars(buckets, classes)
    wanted = cut(among(classes.select("id", "words_hash", "smallest"), cut(stars.select("id").distinct()), "id"))
    signatures = class_signatures(docs, wanted, size)
    links, held = [], None
    while True:
        links.append(links_inside(stars.where(is_small()), docs, classes, signatures, size, percent))
        stars = stars.where(~is_small()).select("star", "id", "members")
        if not stars.limit(1).count():
            break
        ids = cut(stars.select("id").distinct())
        if held is None:
            wanted = cut(among(wanted, ids, "id"))
            held = written(class_words(docs, wanted).join(wanted.select("id", "words_hash"), "words_hash").select("id", "packed"), "near-held")
        held_now = among(held, ids, "id")
        core = cores(stars, held_now, size)
        edges = against_centre(differences(stars, held_now, core, size, percent), held_now, core, size, percent)
        links.append(edges.where("linked").select(F.col("centre").alias("a"), F.col("id").alias("b")))
        stars = next_stars(edges)
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def find_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, words_hash, n_shingles, component_id and kept of each row of docs (doc_id, text)."""
    feats = written(features(docs, size), "near-features")
    known = feats.where("doc_id IS NOT NULL AND words_hash IS NOT NULL")
    classes = known.groupBy("words_hash").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "near-classes")
    labels = components(links_of(docs, classes, size, percent))
    ends = cut(classes.select("id", "smallest").join(labels, "id"))
    heads = ends.groupBy("component").agg(F.min(F.struct("smallest", "id")).alias("head"), F.count("*").alias("nodes"))
    ends = attach_groups(ends, heads, "component", "nodes", ends.count(), F.xxhash64("id"))
    facts = classes.select("id", "words_hash", "smallest", "copies").join(ends.select("id", "head"), "id", "left")
    facts = facts.select("words_hash", "copies", F.coalesce("head.smallest", "smallest").alias("component_id"), (F.col("head").isNull() | (F.col("head.id") == F.col("id"))).alias("is_head"))
    rows = feats.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("words_hash")).alias("words_hash"))
    found = attach_groups(rows, facts, "words_hash", "copies", feats.count(), F.unhex(F.hex(F.xxhash64("doc_id"))))
    head = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "words_hash", "n_shingles", head.alias("component_id"), (F.col("doc_id").eqNullSafe(head) & F.coalesce("is_head", F.lit(True))).alias("kept"))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group: one with the smallest doc_id."""
    found = written(find_near_copies(docs.select("doc_id", "text"), size, percent), "near-found")
    repeated = cut(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    gone = cut(found.where("NOT kept").select("doc_id").unionByName(repeated))
    few = gone.count() < SMALL_IDS
    out = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    if not repeated.limit(1).count():
        return out
    # rows that repeat a doc_id are told apart by their words, and one of equal words stays
    (mark,) = fresh(docs.columns, "_words_hash")
    schema = T.StructType([*docs.schema.fields, T.StructField(mark, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [words_hash(words_of(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes, pa.binary())], names=schema.names)

    again = among(docs, repeated, "doc_id").select(*docs.columns).mapInArrow(run, schema)
    stay = found.where("kept AND words_hash IS NOT NULL").join(repeated, "doc_id", "left_semi").select("doc_id", F.col("words_hash").alias(mark)).distinct()
    worded = again.where(F.col(mark).isNotNull()).dropDuplicates(["doc_id", mark]).join(stay, ["doc_id", mark], "left_semi")
    return out.unionByName(worded.unionByName(again.where(F.col(mark).isNull())).select(*docs.columns))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_near_copies(docs, size=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLES: dict[str, str] = {}
