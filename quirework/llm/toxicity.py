r"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Input: per word, an embedding of the word and the mean embedding of its character n-grams (3 to 6, word ends
marked), both by hash. A forward and a backward gated recurrent network read a window of words; attention pools
their states; a logistic unit gives the window's score. All overlapping windows of a text are scored; the highest
counts. Training is on whole documents: the gradient goes through a document's highest window.

The model is fitted in one task from a bounded sample of labelled rows: of those with at most `longest` characters,
`most_toxic` and `most_clean` rows, the ones with the smallest hashes of their doc_id (parameters of learn()). Its
size doesn't depend on the corpus; the driver sees its parameters (3 MB), no text. Scoring is one narrow pass over all
texts.

Rules: a null, empty or wordless text scores as one empty window, which is scored like any other. Only doc_id, text
and toxic of labelled rows are read, and only text at scoring. Rows with a null doc_id or label aren't learnt from. If
there are no rows of both labels, all scores are 0.5. Repeated rows get equal scores. Extra columns pass through
drop_toxic() whatever their names, and through with_scores() if none is named as its score. An empty table gives an
empty one; a very long text has as many windows as it takes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.llm.common import by_bytes, cut, fresh, release, small_batches, table
from quirework.llm.near_dedup import mix

#: Words in a window, and from one to the next.
WINDOW, STEP = 48, 24
WORD_BUCKETS, GRAM_BUCKETS, WIDTH, HIDDEN, ATTENTION = 1 << 14, 1 << 16, 8, 8, 8
GRAMS = (3, 4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 100_000
#: Pull of the embeddings towards nothing.
DECAY = {"words": 1e-5, "grams": 1e-5}
THRESHOLD = 0.7


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_bucket(words: list[str]) -> np.ndarray:
    """Buckets from 1; bucket 0 is for the empty place."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)).astype(np.int64) % WORD_BUCKETS


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and the number of n-grams of each word."""
    marked = "".join([f"^{w}$" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    of_word = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    room = ends[of_word] - np.arange(len(codes))  # characters of the word from here on
    found, owner = [], []
    for n in GRAMS:
        ok = np.flatnonzero(room >= n)
        h = np.full(len(ok), n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(6364136223846793005) + codes[ok + j]
        found.append((mix(h) % np.uint64(GRAM_BUCKETS)).astype(np.int64))
        owner.append(of_word[ok])
    bucket, own = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return bucket[order], np.bincount(own, minlength=len(words))


def window_starts(n: int) -> list[int]:
    """Starts of the windows that together cover n words."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STEP), n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters and their use. Directions f and b have input weights W, recurrent weights U and biases c."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        d = 2 * WIDTH
        # embeddings start at nothing, so that what was never learnt says nothing
        self.p = {"words": np.zeros((WORD_BUCKETS, WIDTH)), "grams": np.zeros((GRAM_BUCKETS, WIDTH)), "A": r.normal(0, 0.4, (2 * HIDDEN, ATTENTION)), "a": np.zeros(ATTENTION), "v": r.normal(0, 0.4, ATTENTION), "o": r.normal(0, 0.4, 2 * HIDDEN), "q": np.zeros(1)}
        for s in "fb":
            self.p |= {f"W{s}": r.normal(0, d**-0.5, (d, 3 * HIDDEN)), f"U{s}": r.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), f"c{s}": np.zeros(3 * HIDDEN)}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def inputs(self, words: list[str], keep: dict | None = None) -> np.ndarray:
        """The input vector of each word."""
        wb = word_bucket(words)
        gb, counts = gram_buckets(words)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        grams = np.add.reduceat(self.p["grams"][gb], starts, axis=0) / counts[:, None].astype(np.float32) if len(words) else np.empty((0, WIDTH), np.float32)
        if keep is not None:
            keep |= {"wb": wb, "gb": gb, "counts": counts}
        return np.concatenate([self.p["words"][wb], grams * np.float32(3)], axis=1)

    def run(self, drive: np.ndarray, s: str, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, batch, HIDDEN) of one direction; drive: (time, batch, 3 * HIDDEN)."""
        n, b, _ = drive.shape
        u, h = self.p[f"U{s}"], np.zeros((b, HIDDEN), dtype=np.float32)
        out = np.empty((n, b, HIDDEN), dtype=np.float32)
        for t in range(n) if s == "f" else range(n - 1, -1, -1):
            g = sigmoid(drive[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            r, z = g[:, :HIDDEN], g[:, HIDDEN:]
            rh = r * h
            c = np.tanh(drive[t, :, 2 * HIDDEN :] + rh @ u[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            new = h + m * z * (c - h)
            if keep is not None:
                keep.append((t, h, r, z, c, rh, m))
            out[t] = h = new
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """Logits, and what the gradient needs. The empty window has no states; its pooled state is zero."""
        e = np.tanh(states @ self.p["A"] + self.p["a"])
        score = np.where(mask > 0, e @ self.p["v"], np.float32(-1e9))
        w = np.exp(score - score.max(axis=0)) * mask
        w /= np.maximum(w.sum(axis=0), np.float32(1e-9))
        pooled = np.einsum("tb,tbh->bh", w, states)
        return pooled @ self.p["o"] + self.p["q"][0], e, w, pooled

    def logits(self, vectors_f: np.ndarray, vectors_b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logits of windows; vectors are the driven inputs of known words, at: (time, batch) places in them, -1: none."""
        mask = (at >= 0).astype(np.float32)
        states = np.concatenate([self.run(vectors_f[at], "f", mask), self.run(vectors_b[at], "b", mask)], axis=2)
        return self.pool(states, mask)[0]

    def gradient(self, vocabulary: list[str], at: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted logistic loss of windows and its gradient; at: (time, batch) places in the vocabulary, -1: none."""
        p, seen = self.p, {}
        x = self.inputs(vocabulary, seen)
        mask = (at >= 0).astype(np.float32)
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.run((x @ p[f"W{s}"] + p[f"c{s}"])[at], s, mask, kept[s]) for s in "fb"], axis=2)
        y, e, w, pooled = self.pool(states, mask)
        prob = sigmoid(y)
        loss = float((weight * (np.logaddexp(0, y) - target * y)).sum())
        dy = (weight * (prob - target)).astype(np.float32)
        g = {"o": pooled.T @ dy, "q": dy.sum(keepdims=True)}
        dpool = dy[:, None] * p["o"]
        dstates = w[:, :, None] * dpool[None]
        dw = np.einsum("bh,tbh->tb", dpool, states)
        ds = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tb,tba->a", ds, e)
        de = ds[:, :, None] * p["v"] * (1 - e * e)
        g["A"], g["a"] = np.einsum("tbh,tba->ha", states, de), de.sum(axis=(0, 1))
        dstates = dstates + de @ p["A"].T
        dx = np.zeros_like(x)
        flat = np.where(at >= 0, at, 0)
        for s, cols in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u, dh = p[f"U{s}"], np.zeros((at.shape[1], HIDDEN), dtype=np.float32)
            du, ddrive = np.zeros_like(u), np.zeros((*at.shape, 3 * HIDDEN), dtype=np.float32)
            for t, h, r, z, c, rh, m in reversed(kept[s]):
                dh = dh + dstates[t][:, cols]
                dz = dh * m * (c - h) * z * (1 - z)
                dc = dh * m * z * (1 - c * c)
                drh = dc @ u[:, 2 * HIDDEN :].T
                dr = drh * h * r * (1 - r)
                dg = np.concatenate([dr, dz], axis=1)
                du[:, : 2 * HIDDEN] += h.T @ dg
                du[:, 2 * HIDDEN :] += rh.T @ dc
                ddrive[t] = np.concatenate([dg, dc], axis=1)
                dh = dh * (1 - m * z) + drh * r + dg @ u[:, : 2 * HIDDEN].T
            ddrive *= mask[:, :, None]
            summed = np.zeros((len(x), 3 * HIDDEN), dtype=np.float32)
            np.add.at(summed, flat.ravel(), ddrive.reshape(-1, 3 * HIDDEN))
            g[f"U{s}"], g[f"W{s}"], g[f"c{s}"] = du, x.T @ summed, summed.sum(axis=0)
            dx += summed @ p[f"W{s}"].T
        g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
        np.add.at(g["words"], seen["wb"], dx[:, :WIDTH])
        share = dx[:, WIDTH:] * (np.float32(3) / seen["counts"][:, None].astype(np.float32))
        np.add.at(g["grams"], seen["gb"], np.repeat(share, seen["counts"], axis=0))
        return loss, g


def fit(texts: Iterable[str | None], labels: Iterable[int], epochs: int = 8, seed: int = 7, batch: int = 96, steps: int = 240) -> Network | None:
    """Adam on documents' highest windows, at least so many epochs and about so many steps; small samples have small batches.

    Of the texts, which may come from an iterator, only the numbers of their words are kept.
    """
    place: dict[str, int] = {}
    docs = [np.fromiter((place.setdefault(w, len(place)) for w in words_of(t)), dtype=np.int32) for t in texts]
    labels = np.asarray(list(labels), dtype=np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    batch = min(batch, max(16, len(docs) // 12))
    epochs = max(epochs, -(-steps * batch // len(docs)))
    net, rng = Network(seed), np.random.default_rng(seed)
    vocabulary = list(place)
    del place
    # the documents of the rarer label count as half of all, softened
    share = np.clip(labels.mean(), 0.02, 0.98)
    weight = np.where(labels > 0, (0.5 / share) ** 0.5, (0.5 / (1 - share)) ** 0.5).astype(np.float32)
    starts = [np.asarray(window_starts(len(d))) for d in docs]
    first = np.cumsum([0, *[len(x) for x in starts[:-1]]])
    owner = np.repeat(np.arange(len(docs)), [len(x) for x in starts])
    ends = np.cumsum([len(d) for d in docs])
    begin = np.concatenate(starts) + (ends - [len(d) for d in docs])[owner]
    # a word or n-gram of one document alone could only be learnt by heart
    live = common(docs, vocabulary)
    flat = np.concatenate([*docs, np.full(WINDOW, -1, dtype=np.int32)])
    del docs, starts

    def windows(k: np.ndarray | slice) -> np.ndarray:
        """The windows k as (time, batch) places in the vocabulary, -1: none."""
        at = begin[k] + np.arange(WINDOW)[:, None]
        return np.where(at < ends[owner[k]], flat[np.minimum(at, len(flat) - 1)], -1)

    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch == 0:
            best = first + (rng.random(len(labels)) * np.diff(np.r_[first, len(owner)])).astype(np.int64)
        else:
            known = driven(net, vocabulary)
            y = np.concatenate([net.logits(*known, windows(slice(k, k + 1024))) for k in range(0, len(owner), 1024)])
            del known
            top = np.maximum.reduceat(y, first)
            best = np.full(len(labels), -1)
            hit = np.flatnonzero(y == top[owner])[::-1]
            best[owner[hit]] = hit
        rate = 0.02 * (1 - epoch / epochs) + 0.002
        for k in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
            own = windows(best[k])
            used, inner = np.unique(own, return_inverse=True)
            inner = inner.reshape(own.shape)
            if used[0] == -1:
                used, inner = used[1:], inner - 1
            _, g = net.gradient([vocabulary[i] for i in used], inner, labels[k], weight[k] / len(k))
            step += 1
            for name, v in net.p.items():
                x = g[name].astype(np.float32) * live.get(name, np.float32(1)) + np.float32(DECAY.get(name, 1e-5)) * v
                m1[name] += np.float32(0.1) * (x - m1[name])
                m2[name] += np.float32(0.01) * (x * x - m2[name])
                net.p[name] = v - np.float32(rate / (1 - 0.9**step)) * m1[name] / (np.sqrt(m2[name] / np.float32(1 - 0.99**step)) + np.float32(1e-7))
    return net


def common(docs: list[np.ndarray], vocabulary: list[str], least: int = 3, step: int = 5_000) -> dict[str, np.ndarray]:
    """Which embeddings are met in `least` documents or more, as columns of 0 and 1."""
    n = np.zeros(len(vocabulary))
    for d in docs:
        n[np.unique(d)] += 1
    words, grams = np.zeros(WORD_BUCKETS), np.zeros(GRAM_BUCKETS)
    for k in range(0, len(vocabulary), step):  # some at a time, as n-grams are many
        some, uses = vocabulary[k : k + step], n[k : k + step]
        gb, counts = gram_buckets(some)
        words += np.bincount(word_bucket(some), weights=uses, minlength=WORD_BUCKETS)
        grams += np.bincount(gb, weights=np.repeat(uses, counts), minlength=GRAM_BUCKETS)
    return {"words": (words >= least).astype(np.float32)[:, None], "grams": (grams >= least).astype(np.float32)[:, None]}


def driven(net: Network, words: list[str], step: int = 5_000) -> tuple[np.ndarray, np.ndarray]:
    """What both directions make of each word's input, some words at a time, as n-grams are many."""
    f, b = (np.empty((len(words), 3 * HIDDEN), dtype=np.float32) for _ in "fb")
    for k in range(0, len(words), step):
        x = net.inputs(words[k : k + step])
        f[k : k + step], b[k : k + step] = x @ net.p["Wf"] + net.p["cf"], x @ net.p["Wb"] + net.p["cb"]
    return f, b


class Scorer:
    """Scores texts, and remembers what the network's input layer makes of a word."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.net = Network.__new__(Network)
        self.net.p = params
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.f = np.empty((1 << 16, 3 * HIDDEN), dtype=np.float32)
        self.b = np.empty((1 << 16, 3 * HIDDEN), dtype=np.float32)

    def learn(self, words: list[str]) -> None:
        n = len(self.place)
        self.place.update(zip(words, range(n, n + len(words)), strict=True))
        while len(self.place) > len(self.f):
            self.f, self.b = (np.concatenate([x, np.empty_like(x)]) for x in (self.f, self.b))
        self.f[n : n + len(words)], self.b[n : n + len(words)] = driven(self.net, words)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The highest window's score of each text."""
        if len(self.place) > REMEMBERED:
            self.forget()
        docs = [words_of(t) for t in texts]
        if new := list(dict.fromkeys(w for d in docs for w in d if w not in self.place)):
            self.learn(new)
        get, tops = self.place.__getitem__, np.full(len(docs), -np.inf, dtype=np.float32)
        flat = np.fromiter(map(get, chain.from_iterable(docs)), dtype=np.int32, count=sum(map(len, docs)))
        flat = np.concatenate([flat, np.full(WINDOW, -1, dtype=np.int32)])
        starts = [np.asarray(window_starts(len(d))) for d in docs]
        own = np.repeat(np.arange(len(docs)), [len(x) for x in starts])
        sizes = np.asarray([len(d) for d in docs])
        ends = np.cumsum(sizes)
        begin = np.concatenate(starts) + (ends - sizes)[own]
        del docs, starts
        for k in range(0, len(own), 2048):
            at = begin[k : k + 2048] + np.arange(WINDOW)[:, None]
            at = np.where(at < ends[own[k : k + 2048]], flat[np.minimum(at, len(flat) - 1)], -1)
            np.maximum.at(tops, own[k : k + 2048], self.net.logits(self.f, self.b, at))
        return sigmoid(tops.astype(np.float64))


@lru_cache(maxsize=1)
def scorer_of(model_id: str, model: "Model") -> Scorer:
    return Scorer(model.params)


class Model:
    """What goes to the workers; compared by its id."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.params = params
        self.id = xxhash.xxh64_hexdigest(b"".join(np.ascontiguousarray(v).tobytes() for _, v in sorted(params.items())))

    def __hash__(self) -> int:
        return hash(self.id)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Model) and other.id == self.id


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: the remainder of crc32(doc_id as text) by 3 is 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, most_toxic: int = 2500, most_clean: int = 3500, longest: int = 8000) -> Model | None:
    """Fit on a bounded sample of the labelled rows that aren't held out.

    Rows that repeat a doc_id give it all its texts and labels, each pair once; a sample of so many doc_ids and labels
    holds those with the smallest hashes among the rows of at most `longest` characters.
    """
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)").distinct()
    short = docs.where(F.length("text") <= longest).select("doc_id").distinct()
    usable = cut(usable.join(short, "doc_id"))
    counts = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    spread = 1 << 30
    picks = []
    for toxic, most in ((1, most_toxic), (0, most_clean)):
        # about 1.3 times what is wanted, so that no task has to order many rows
        share = min(1.0, 1.3 * (most + 100) / max(1, counts.get(toxic, 0)))
        some = usable.where((F.col("toxic") == toxic) & (F.pmod(F.xxhash64("doc_id"), F.lit(spread)) <= int(spread * share)))
        picks.append(some.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(spread)), "doc_id").limit(most))
    sample = picks[0].union(picks[1])  # most_toxic + most_clean rows at most
    rows = docs.where(F.length("text") <= longest).select("doc_id", "text").join(F.broadcast(sample), "doc_id").distinct()
    one = rows.repartition(1).sortWithinPartitions("doc_id", "text", "toxic").select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: list[int] = []

        def texts() -> Iterator[str | None]:
            for b in batches:
                toxic.extend(b.column("toxic").to_pylist())
                yield from (t.as_py() for t in b.column("text"))

        # fit() reads all texts before it asks for the labels
        net = fit(texts(), toxic)
        p = {} if net is None else net.p
        release()
        yield pa.RecordBatch.from_arrays([pa.array(list(p), pa.string()), pa.array([list(v.shape) for v in p.values()], pa.list_(pa.int32())), pa.array([v.astype("<f4").tobytes() for v in p.values()], pa.binary())], names=["name", "shape", "data"])

    found = cut(small_batches(one).mapInArrow(run, "name string, shape array<int>, data binary")).collect()
    return Model({r["name"]: np.frombuffer(r["data"], dtype="<f4").reshape(r["shape"]) for r in found}) if found else None


def with_scores(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, score: str = "score") -> DataFrame:
    """docs (or its columns in keep) with their score, in a column of that name."""
    names = docs.columns if keep is None else keep
    if model is None:
        return docs.select(*names, F.lit(0.5).alias(score))
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model.id, model)
        for whole in batches:
            for batch in by_bytes(whole, text, rows=400):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scorer.score(batch.column(text).to_pylist()), pa.float64())], names=schema.names)
        scorer.forget()  # a worker may serve other stages next
        release()

    return small_batches(docs).select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score below THRESHOLD."""
    (score,) = fresh(docs.columns, "score")
    return with_scores(docs, learn(docs, labels), score=score).where(F.col(score) < THRESHOLD).select(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, learn(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
