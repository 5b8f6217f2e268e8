"""Packing into sequences: vector bin packing with the dot-product heuristic.

A sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. It is filled piece by piece:
of all pieces that still fit, the one whose vector of needs, as shares of the limits, has the greatest dot product
with the vector of what is left. Instruction examples (pack_examples()) are never cut; one that is too large for the
limits gets a sequence of its own, marked `oversize`. Documents (pack_documents()) may be cut: whole sequences are cut
off long ones first, and if no piece fits any more, the room that is left (if it is worth it) is filled with a cut off
the largest. All tokens of a document bear loss, so there tokens and loss-bearing tokens are one need. The last
sequence of a group is laid out as powers of two, which need no padding.

Rows are dealt to groups of about group_rows rows and group_tokens tokens by a hash of their id and length, so groups
are even even if all ids are null, each is packed by one task, and a group that is computed again gives the same
pieces. A sequence's id is its group's number times 2**32 plus its number in the group.

Rules: a null or empty text has the end mark alone. Repeated rows are packed each on their own. Extra columns ride
along; they may not have the names of the added ones, but any other. An empty table gives an empty one; a very long
text is cut into sequences.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.llm.chat import format_chats, read_back
from quirework.llm.common import by_bytes, fresh, release, small_batches, table, written

TOKENIZER = "word_bpe_49k.json"
END = 1
#: Words whose ids a worker remembers.
REMEMBERED = 200_000
#: Letters of a word that is long: its tokens would be a Python object each.
LONG = 1000
#: Latin, Greek and Cyrillic.
SCRIPTS = range(0x61, 0x530)
#: Marks (a class) that the tokenizer always splits from the letters before them: all of ASCII but the apostrophe.
MARKS = r"!-&(-/:-@\[-`{-~"


class WordEncoder:
    """Token ids of texts, word by word.

    The tokenizer never joins what white space parts, nor letters with the marks after them, so a text's ids are those
    of its words in order, and a word's are those of its letters and of its tail of marks. Texts are split and their
    distinct words and parts numbered by Arrow; Python sees each distinct part of a batch once, and what comes again need
    not be encoded again. Of lower-case letters that the normalizer keeps, only the tokenizer's model is asked: they are
    one piece already. All others are encoded as they were written, as letters and marks may join when they are lowered.
    The ids of known parts stand one after another in one array.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        if max(self.tok.get_vocab().values()) >= 1 << 16:
            raise ValueError("16-bit ids can't hold this vocabulary")
        #: The model's spelling of each letter; no two of these scripts' letters compose.
        self.spelled: dict[int, str] = {}
        for c in map(chr, SCRIPTS):
            if c.isalpha() and self.tok.normalizer.normalize_str(c) == c and len(self.tok.pre_tokenizer.pre_tokenize_str(f"a{c}")) == 1:
                self.spelled[ord(c)] = self.tok.pre_tokenizer.pre_tokenize_str(c)[0][0]
        letters = "".join(map(chr, self.spelled))
        self.letters = re.compile(f"[{letters}]+")
        self.parts = f"^(?P<letters>[{letters}]+)(?P<tail>[{MARKS}]*)$"
        self.forget()

    def forget(self) -> None:
        #: The number of each known part; part 0 is the empty one, part k has the ids from ends[k - 1] to ends[k].
        self.known: dict[str, int] = {"": 0}
        self.ids, self.used = np.empty(1 << 20, dtype=np.uint16), 0
        self.ends = np.zeros(1 << 16, dtype=np.int32)

    def _add(self, parts: list[str], ids: array, sizes: list[int]) -> None:
        n = len(self.known)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + len(parts) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.empty_like(self.ends)])
        self.known.update(zip(parts, range(n, n + len(parts)), strict=True))
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[n : n + len(parts)] = self.used + np.cumsum(sizes)
        self.used += len(ids)

    def learn(self, parts: list[str]) -> None:
        plain, odd, ids, sizes = [], [], array("H"), []
        for part in parts:
            if len(part) <= LONG and self.letters.fullmatch(part):
                found = self.model.tokenize(part if part.isascii() else part.translate(self.spelled))
                plain.append(part)
                ids.extend([t.id for t in found])
                sizes.append(len(found))
            else:
                odd.append(part)
        self._add(plain, ids, sizes)
        for i in range(0, len(odd), 2000):
            found = [e.ids for e in self.tok.encode_batch_fast(odd[i : i + 2000], add_special_tokens=False)]
            self._add(odd[i : i + 2000], array("H", chain.from_iterable(found)), list(map(len, found)))

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        parts = parts.dictionary_encode()
        distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        if missing := [p for p in distinct if p not in self.known]:
            self.learn(missing)
        return np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int32, count=len(distinct))[parts.indices.to_numpy()]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        letters, tail = pc.extract_regex(pc.ascii_lower(words), pattern=self.parts).flatten()
        number = np.empty((len(words), 2), dtype=np.int32)
        number[:, 0] = self._numbers(pc.coalesce(letters, words))
        number[:, 1] = self._numbers(pc.fill_null(tail, ""))
        stop = self.ends[number]
        start = np.where(number > 0, self.ends[number - 1], np.int32(0))
        return gather(self.ids, start.ravel(), (stop - start).ravel()), (stop - start).sum(axis=1, dtype=np.int32)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has; each with the id end after it, if given."""
        if len(self.known) > REMEMBERED:
            self.forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        split = split if isinstance(split, pa.Array) else split.combine_chunks()
        offsets = split.offsets.to_numpy().astype(np.int64)
        words = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        first, last = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        ids, n = self._words(words.dictionary)
        start, number = np.cumsum(n, dtype=np.int32) - n, words.indices.to_numpy()
        if end is not None:  # one more word after each text's
            number = np.insert(number, last, np.int32(len(n)))
            ids, start, n = np.append(ids, np.uint16(end)), np.append(start, np.int32(len(ids))), np.append(n, np.int32(1))
            first, last = first + np.arange(len(first)), last + np.arange(1, len(last) + 1)
        n = n[number]
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)])
        return gather(ids, start[number], n), (total[last] - total[first]).astype(np.int64)


def gather(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n ids from each start on, one run after another."""
    at = np.cumsum(n, dtype=np.int32)
    return ids[np.repeat(start - (at - n), n) + np.arange(at[-1] if len(at) else 0, dtype=np.int32)]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """A worker keeps its encoder, and what that has learnt, from task to task."""
    return WordEncoder(path)


def tokenise(docs: DataFrame, path: str | None = None, text: str = "text", end: int = END) -> DataFrame:
    """docs without their text, with `ids` (binary, little-endian unsigned 16-bit) and doc_tokens, the end id included."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    others = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*others, T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for whole in batches:
            for batch in by_bytes(whole, text, rows=10_000, size=4 << 20):
                ids, counts = encoder.encode(batch.column(text), end)
                cols = [batch.column(f.name) for f in others]
                yield pa.RecordBatch.from_arrays([*cols, binary(ids, counts), pa.array(counts, pa.int64())], names=[f.name for f in schema])
                del ids, counts
        release()

    return small_batches(docs).select(*[F.col(f"`{f.name}`") for f in others], text).mapInArrow(run, schema)


def binary(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The ids as one binary value for each count."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * ids.itemsize
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
    return pa.array([ids.view(np.uint8)[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


def fill(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int], least_cut: int | None) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length). least_cut: the least room worth a cut; None: nothing is cut."""
    most, segments, most_loss = limits
    left, lost, start = tokens.astype(np.int64).copy(), loss.astype(np.int64).copy(), np.zeros(len(tokens), dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = []
    if least_cut is not None:
        step = min(most, most_loss)
        for i in np.flatnonzero(left >= step):
            while left[i] >= step:
                out.append([(int(i), int(start[i]), step)])
                start[i] += step
                left[i] -= step
                lost[i] -= step
    else:
        for i in np.flatnonzero((left > most) | (lost > most_loss)):
            out.append([(int(i), 0, int(left[i]))])
            left[i] = 0
    alive = np.flatnonzero(left > 0)
    t, x, ids = left[alive], lost[alive], alive.copy()
    order = np.argsort(-t, kind="stable")
    t, x, ids = t[order], x[order], ids[order]
    while len(t):
        seq, room, segs, spare = [], most, segments, most_loss
        used = np.zeros(len(t), dtype=bool)
        while segs and room:
            fits = (t <= room) & (x <= spare) & ~used
            if fits.any():
                score = t * (room / most**2) + x * (spare / most_loss**2) + segs / segments**2
                k = int(np.argmax(np.where(fits, score, -1.0)))
                seq.append((int(ids[k]), int(start[ids[k]]), int(t[k])))
                used[k] = True
                room, segs, spare = room - int(t[k]), segs - 1, spare - int(x[k])
                continue
            cut = min(room, spare)
            if least_cut is None or cut < least_cut or used.all():
                break
            k = int(np.argmax(np.where(used, -1, t)))
            seq.append((int(ids[k]), int(start[ids[k]]), cut))
            start[ids[k]] += cut
            t[k] -= cut
            x[k] -= cut
            break
        out.append(seq)
        t, x, ids = t[~used], x[~used], ids[~used]
    return out


def powers_of_two(seq: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The sequence cut into sequences whose lengths are powers of two."""
    total, out, k = sum(p[2] for p in seq), [], 0
    todo = list(seq)
    for bit in range(total.bit_length() - 1, -1, -1):
        room = total & (1 << bit)
        part = []
        while room:
            i, s, n = todo[k]
            m = min(n, room)
            part.append((i, s, m))
            room -= m
            if m == n:
                k += 1
            else:
                todo[k] = (i, s + m, n - m)
        if part:
            out.append(part)
    return out


def pack(rows: DataFrame, tokens: str, loss: str | None = None, ids: str | None = None, limits: tuple[int, int, int] = (2048, 512, 2048), least_cut: int | None = None, group_rows: int = 2048, group_tokens: int = 1 << 22, id_col: str = "doc_id", groups: int | None = None) -> DataFrame:
    """Add start, length, sequence_id, offset and oversize; one row per piece.

    loss: the column of loss-bearing token counts (all tokens, if None). ids: the column of token ids (unsigned
    16-bit), which are cut as the rows are and come back as unsigned 32-bit numbers; documents can be cut if all
    their tokens bear loss (least_cut is given).
    """
    if least_cut is not None and loss is not None:
        raise ValueError("only rows whose tokens all bear loss can be cut")
    if groups is None:
        n, total = rows.agg(F.count("*"), F.sum(tokens)).first()
        groups = max(1, -(-n // group_rows), -(-(total or 0) // group_tokens))
    tie_name, group_name = fresh(rows.columns, "_tie", "_group")
    added = [("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("sequence_id", T.LongType(), pa.int64()), ("offset", T.LongType(), pa.int64()), ("oversize", T.BooleanType(), pa.bool_())]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(a, b) for a, b, _ in added)])
    names = rows.columns

    def run(key: tuple, part: pa.Table) -> pa.Table:
        g = key[0].as_py()
        part = part.select([*names, tie_name]).sort_by([(id_col, "ascending"), (tokens, "ascending"), (tie_name, "ascending")]).select(names)
        t = part.column(tokens).to_numpy().astype(np.int64)
        x = part.column(loss).to_numpy().astype(np.int64) if loss else t
        seqs = [s for s in fill(t, x, limits, least_cut) if s]
        if least_cut is not None and seqs and 0 < sum(p[2] for p in seqs[-1]) < limits[0]:
            seqs[-1:] = powers_of_two(seqs[-1])
        flat = [(i, s, m, (g << 32) + q, off, m > limits[0] or (not least_cut and x[i] > limits[2])) for q, seq in enumerate(seqs) for (i, s, m), off in zip(seq, np.cumsum([0, *[p[2] for p in seq[:-1]]]).tolist(), strict=True)]
        others = [c for c in names if c != ids]
        out = part.select(others).take(pa.array([f[0] for f in flat], pa.int64()))
        if ids:  # cut from each row as it is: no row is copied as often as it has pieces
            raw = [np.frombuffer(x.as_buffer(), "<u2") for x in part.column(ids)]
            lengths = np.asarray([f[2] for f in flat], dtype=np.int64)
            pieces = [raw[f[0]][f[1] : f[1] + f[2]] for f in flat]
            flat_ids = np.concatenate(pieces).astype("<u4") if pieces else np.empty(0, "<u4")
            out = out.append_column(ids, binary(flat_ids, lengths)).select(names)
        for k, (name, _, kind) in enumerate(added, start=1):
            out = out.append_column(name, pa.array([bool(f[k]) if k == 5 else int(f[k]) for f in flat], kind))
        return out

    tie = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    dealt = rows.withColumn(tie_name, tie).withColumn(group_name, F.pmod(F.xxhash64(id_col, tokens, tie_name), F.lit(groups)).cast("long"))
    return dealt.groupBy(group_name).applyInArrow(lambda key, part: run(key, part), schema)


def pack_documents(docs: DataFrame, path: str | None = None, limits: tuple[int, int, int] = (2048, 512, 2048), least_cut: int = 16, group_rows: int = 2048, group_bytes: int = 8 << 20) -> DataFrame:
    """Tokenise and pack; one row per piece, with its ids (binary, unsigned 32-bit), and the columns of docs but text."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-n // group_rows), -(-(size or 0) // group_bytes))
    return pack(tokenise(docs, path), "doc_tokens", ids="ids", limits=limits, least_cut=least_cut, groups=groups)


def pack_examples(chats: DataFrame, path: str | None = None, limits: tuple[int, int, int] = (2048, 16, 1024)) -> DataFrame:
    """Pack formatted conversations (conv_id, formatted, loss_text) whole, under all three limits.

    An example's tokens are those of its formatted text and the end mark; its loss-bearing ones are those of the text
    under its loss mask. One row per example: conv_id, tokens, loss, sequence_id, offset, oversize.
    """
    tokens = tokenise(chats.select("conv_id", "loss_text", F.col("formatted").alias("text")), path).select("conv_id", "loss_text", F.col("doc_tokens").alias("tokens"))
    loss = tokenise(tokens.withColumnRenamed("loss_text", "text"), path).select("conv_id", "tokens", (F.col("doc_tokens") - 1).alias("loss"))
    packed = pack(written(loss, "packing-examples"), "tokens", "loss", limits=limits, id_col="conv_id")
    return packed.select("conv_id", "tokens", "loss", "sequence_id", "offset", "oversize")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted by the chat grammar, packed under three limits."""
    chats = read_back(format_chats(table(spark, sf_dir, "conversations")))
    return pack_examples(chats.select("conv_id", "formatted", "loss_text"))


QUERIES = {"op3_packing": op3_packing, "instruction_packing": instruction_packing}
ORACLES: dict[str, str] = {}
