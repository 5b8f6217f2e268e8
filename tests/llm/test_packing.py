import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirework.llm import packing


def plain_ids(texts):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return [np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, packing.END], dtype="<u4") for t in texts]


def check(pieces, ids_of, most=2048):
    seqs, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    padded = total = 0
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))]
        n = sum(n for _, n in s)
        assert n <= most
        total += n
        padded += 0 if n & (n - 1) == 0 else most - n
    for d, parts in docs.items():
        at, ids = 0, ids_of[d]
        for start, n, crc, all_ in sorted(parts):
            assert start == at and all_ == len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes())
            at += n
        assert at == len(ids)
    assert set(docs) == set(ids_of)
    return padded / total


def test_query_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ids = dict(zip([d.doc_id for d in docs], plain_ids([d.text for d in docs]), strict=True))
    assert check(packing.op3_packing(spark, sf_dir).collect(), ids) < 0.02


def test_odd_texts(odd_docs, odd_rows, no_docs):
    rows = {r[0]: r[1] for r in odd_rows if r[0] not in (None, 8)}
    some = odd_docs.where("doc_id IS NOT NULL AND doc_id <> 8")
    got = packing.pack_documents(some).withColumn("ids_crc32", F.crc32("ids"))
    assert {"lang", "source", "kept_extra"} <= set(got.columns)
    check(got.collect(), dict(zip(rows, plain_ids(rows.values()), strict=True)))
    rest = packing.pack_documents(odd_docs.where("doc_id IS NULL OR doc_id = 8"))
    assert rest.agg(F.sum("length")).first()[0] == sum(len(x) for x in plain_ids([r[1] for r in odd_rows if r[0] in (None, 8)]))
    assert packing.pack_documents(no_docs).count() == 0


def test_encoder_on_odd_words():
    texts = ["don't I'LL ﬁ ǆ é́ naïve İstanbul ΣΑΣ  a\tb\x0bc\x1cd e <|endoftext|> x.y.z 12,5% “q” 中文字 abc1def ....", "", "Word. word, WORD; word", "á b c"]
    e = packing.WordEncoder(public_tokenizers.path(packing.TOKENIZER))
    ids, counts = e.encode(pa.array([*texts, None, "  \t "]), end=packing.END)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.tolist() for x in plain_ids([*texts, None, "  \t "])]
    again, counts = e.encode(pa.array([*texts, None]).slice(1, 3))
    assert [x.tolist() for x in np.split(again, np.cumsum(counts)[:-1])] == [x.tolist()[:-1] for x in plain_ids([*texts, None])[1:4]]
    assert [len(x) for x in e.encode(pa.array([], pa.string()))] == [0, 0]


def test_letters_need_the_model_alone():
    """The whole tokenizer, which costs three times as much a word, sees only words that are more than letters and marks."""

    class Asked:
        def __init__(self, tok):
            self.tok, self.texts = tok, []

        def encode_batch_fast(self, texts, **options):
            self.texts += texts
            return self.tok.encode_batch_fast(texts, **options)

    rng = np.random.default_rng(4)
    words = ["".join(rng.choice([*"abcdefghijklmnoprstuüéñßжω"], rng.integers(1, 9))) for _ in range(3000)]
    texts = [" ".join(w.capitalize() if w[0].isascii() and i % 9 == 0 else w + ["", "", ",", ".%%%"][i % 4] for i, w in enumerate(words)), "x-ray " + "a" * 5000]
    e = packing.WordEncoder(public_tokenizers.path(packing.TOKENIZER))
    e.tok = asked = Asked(e.tok)
    ids, counts = e.encode(pa.array(texts), end=packing.END)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.tolist() for x in plain_ids(texts)]
    assert sorted(asked.texts) == sorted([",", ".%%%", "x-ray", "a" * 5000])


def test_capitals_that_cannot_be_lowered_alone():
    """H, T, W, Y and J compose with these marks only when small; a control string in capitals is none."""
    texts = ["H\u0331ello T\u0308 W\u030a, J\u030c Y\u030a", "a <|ENDOFTEXT|> b<|endoftext|>c <|StartOfText|>."]
    ids, counts = packing.WordEncoder(public_tokenizers.path(packing.TOKENIZER)).encode(pa.array(texts), end=packing.END)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.tolist() for x in plain_ids(texts)]


def test_three_limits(spark):
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 700, 900)
    loss = (tokens * rng.random(900)).astype(int)
    rows = spark.createDataFrame([(int(i), int(t), int(x)) for i, (t, x) in enumerate(zip(tokens, loss, strict=True))] + [(9000, 5000, 1), (9001, 10, 900)], "doc_id long, tokens long, loss long")
    got = packing.pack(rows, "tokens", "loss", limits=(1024, 6, 400)).collect()
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    assert sorted(r.doc_id for r in got) == [*range(900), 9000, 9001]
    for s in seqs.values():
        if any(r.oversize for r in s):
            assert len(s) == 1
            continue
        assert sum(r.tokens for r in s) <= 1024 and len(s) <= 6 and sum(r.loss for r in s) <= 400
    lower = max(tokens.sum() / 1024, loss.sum() / 400, 900 / 6)
    assert len(seqs) - 2 <= 1.1 * lower + 2


def test_examples_under_three_limits(spark, sf_dir):
    """Each conversation once, its tokens and loss counted here, no limit passed, and each of the three met somewhere."""
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = defaultdict(list)
    for r in chats.collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    want = {}
    for c, t in turns.items():
        t.sort()
        whole = "".join(f"<s>[{role}]{text}</s>" for _, role, text in t)
        said = "".join(text for _, role, text in t if role == "assistant")
        want[c] = (len(plain_ids([whole])[0]), len(plain_ids([said])[0]) - 1)
    got = packing.instruction_packing(spark, sf_dir).collect()
    assert {r.conv_id: (r.tokens, r.loss) for r in got} == want and len(got) == len(want)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.tokens for x in s[:i]) for i in range(len(s))]
        assert any(r.oversize for r in s) or (sum(r.tokens for r in s) <= 2048 and len(s) <= 16 and sum(r.loss for r in s) <= 1024)


def test_heuristic_step_by_step():
    """fill() against the heuristic written plainly."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        t = rng.integers(1, 60, 40)
        x = (t * rng.random(40)).astype(int)
        limits, left, want = (100, 4, 50), list(np.argsort(-t, kind="stable")), []
        while left:
            seq, room = [], list(limits)
            while fits := [i for i in left if t[i] <= room[0] and 1 <= room[1] and x[i] <= room[2]]:
                k = max(fits, key=lambda i: (t[i] * (room[0] / limits[0] ** 2) + x[i] * (room[2] / limits[2] ** 2) + room[1] / limits[1] ** 2, -left.index(i)))
                seq.append((int(k), 0, int(t[k])))
                left.remove(k)
                room = [room[0] - t[k], room[1] - 1, room[2] - x[k]]
            want.append(seq) if seq else left.pop(0)
        got = [s for s in packing.fill(t, x, limits, None) if sum(x[p[0]] for p in s) <= 50]
        assert got == [s for s in want if s]


def test_very_long_text(spark):
    docs = spark.range(1).selectExpr("7L AS doc_id", "repeat('some words, of a long text. ', 1900000) AS text")  # 53 MB
    got = packing.pack_documents(docs).select("start", "length").collect()
    at = 0
    for r in sorted(got):
        assert r.start == at
        at += r.length
    assert at == 1900000 * 8 + 1
