r"""Personal data: seed patterns, and contextual extraction bootstrapped from them.

Seeds are e-mail addresses, IP addresses, payment cards and phone numbers found by fixed patterns, and, with less
trust, strings that look machine-made (KEY: 16 characters or more with letters and digits mixed). Each seed and each
other token that has a digit and four characters, or stands behind a sign of assignment, is an instance; the words
around it make three lexical patterns: the two words before, the word before and the word after, the two words after.
Patterns and instances form a bipartite graph, which Spark scores in rounds: a pattern's confidence is the share of
confidence among its distinct instances, smoothed, if it has enough confident ones; an instance's is one minus the
chance that all its patterns are wrong. Confidence only grows, base seeds keep 1, and rounds end when no more
instances pass `accept`. Instances that do are personal data or secrets, of kind `id`, wherever a token of that text
stands in a context of a confident pattern. A machine-made string in a context of its own isn't reported: it takes a
pattern that several distinct ones share.

All counting is by grouped aggregation over (pattern, instance) pairs, which merge before they are shuffled; frequent
patterns and instances are joined by attach_groups().

Rules: a null text counts as empty. Offsets are code points, ends exclusive. Kinds are searched for each on its own
and may overlap; what is discovered never overlaps a base span. A match that fails its test (IP parts over 255, digits
out of number, wrong check digit) is dropped and what it covers isn't searched again. Rows that repeat doc_id and text
get equal results. Extra columns are ignored. An empty table gives an empty one; very long texts are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.llm.common import attach_groups, by_bytes, cut, release, table, written

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
#: Parts of the fixed patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\s\"'<>(),;:=\[\]{}]+")
#: What looks machine-made, and how far that is believed.
KEY = re.compile(r"(?=(?:[^0-9]*[0-9]){4})(?=(?:[^A-Za-z]*[A-Za-z]){3})[A-Za-z0-9_-]{16,}")
KEY_TRUST = 0.9
ASSIGNS = re.compile(r"[=:]\s*[\"']?$")
QUOTES = "\"'<>()[]{}"
#: Characters on each side in which words of context are looked for first; the search goes on while there are too few.
REACH = 80

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
MENTION = T.StructType([*SPAN.fields, T.StructField("instance", T.StringType()), T.StructField("prior", T.DoubleType()), T.StructField("patterns", T.ArrayType(T.StringType()))])
SCANNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row_key", T.LongType()), T.StructField("mentions", T.ArrayType(MENTION))])


def emails(text: str) -> list[tuple[int, int]]:
    r"""[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, searched from each @ outwards."""
    out, bound = [], 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        a = m.start()
        while a > bound and text[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            out.append((a, m.end()))
            bound = m.end()
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for c in digits[-2::-2]:
        d = 2 * int(c)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of all seeds, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            if m.group(1) and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def words_before(text: str, start: int) -> list[str]:
    """The two words before a place, whole however long."""
    reach = REACH
    while True:
        found = text[max(0, start - reach) : start].rstrip(QUOTES).split()
        if len(found) > 2 or reach >= start:
            return found[-2:]
        reach *= 4


def words_after(text: str, end: int) -> list[str]:
    reach = REACH
    while True:
        found = text[end : end + reach].lstrip(QUOTES).split()
        if len(found) > 2 or end + reach >= len(text):
            return found[:2]
        reach *= 4


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span; digits are masked, so that a pattern never holds an identifier."""
    before = [DIGIT.sub("#", w.lower()) for w in words_before(text, start)]
    after = [DIGIT.sub("#", w.lower()) for w in words_after(text, end)]
    out = []
    if len(before) == 2:
        out.append("b " + " ".join(before))
    if before and after:
        out.append(f"m {before[-1]} {after[0]}")
    if len(after) == 2:
        out.append("a " + " ".join(after))
    return out


def mentions(text: str) -> list[dict]:
    """All seeds and all other tokens that may be identifiers, with their contexts."""
    seeds = base_spans(text)
    out = [{"kind": KINDS[k], "start": a, "end": b, "instance": text[a:b].lower(), "prior": 1.0, "patterns": contexts(text, a, b)} for a, k, b in seeds]
    if DIGIT.search(text) or "=" in text or ":" in text:
        covered, k = 0, 0  # seeds before k begin before the token; the furthest of them ends at covered
        for m in TOKEN.finditer(text):
            raw = m.group()
            token = raw.rstrip(".!?-")
            a, b = m.start(), m.start() + len(token)
            has_digit = len(token) >= 4 and DIGIT.search(token)
            if not token or not (has_digit or ASSIGNS.search(text, max(0, a - 8), a)):
                continue
            while k < len(seeds) and seeds[k][0] < b:
                covered, k = max(covered, seeds[k][2]), k + 1
            if covered <= a:
                out.append({"kind": None, "start": a, "end": b, "instance": token.lower(), "prior": KEY_TRUST if has_digit and KEY.fullmatch(token) else 0.0, "patterns": contexts(text, a, b)})
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row_key and mentions of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("prior", pa.float64()), ("patterns", pa.list_(pa.string()))]))
        for whole in batches:
            for b in by_bytes(whole, text, rows=1000):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array([mentions(t or "") for t in b.column(text).to_pylist()], kind)], names=SCANNED.names)
        release()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", text).alias("row_key"), text).mapInArrow(run, SCANNED)


def score(edges: DataFrame, support: int, accept: float) -> tuple[DataFrame, DataFrame]:
    """Confident patterns and accepted instances. edges: pattern, instance, prior; one row per pair."""
    n = edges.count()
    confidence, accepted = None, -1
    while True:
        held = edges.withColumn("conf", F.col("prior"))
        if confidence is not None:
            held = attach_groups(edges, confidence, "instance", "degree", n, F.concat(F.lit("\0"), F.col("pattern"))).withColumn("conf", F.greatest("prior", F.coalesce("conf", F.lit(0.0)))).drop("degree")
        by_pattern = held.groupBy("pattern").agg(F.sum("conf").alias("good"), F.count("*").alias("degree"))
        patterns = cut(by_pattern.where(F.col("good") >= support).select("pattern", "degree", (F.col("good") / (F.col("degree") + 2)).alias("trust")))
        wanted = attach_groups(edges.where("prior < 1").select("pattern", "instance"), patterns, "pattern", "degree", n, F.concat(F.lit("\0"), F.col("instance")), how="inner")
        confidence = cut(wanted.groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("conf"), F.count("*").alias("degree")))
        now = confidence.where(F.col("conf") >= accept).count()
        if now <= accepted:
            return patterns, confidence.where(F.col("conf") >= accept)
        accepted = now


def find_personal_data(docs: DataFrame, text: str = "text", support: float = 2.5, accept: float = 0.7, trust: float = 0.5) -> DataFrame:
    """doc_id, row_key and spans (kind, start, end; sorted) of each row."""
    scanned = written(scan(docs, text), "pii-mentions")
    key = F.struct("doc_id", "row_key").alias("row")
    single = scanned.where(F.size("mentions") > 0).select(key, F.explode("mentions").alias("m")).select("row", "m.kind", "m.start", "m.end", "m.instance", "m.prior", "m.patterns")
    edges = cut(single.select("instance", "prior", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("prior").alias("prior")))
    patterns, accepted = score(edges, support, accept)
    n = single.count()
    place = F.concat(F.lit("\0"), F.col("row").cast("string"), F.col("start").cast("string"))
    tokens = attach_groups(single.where("kind IS NULL"), accepted, "instance", "degree", n, place, how="inner").drop("degree")
    placed = tokens.select("row", "start", "end", F.explode("patterns").alias("pattern"))
    placed = attach_groups(placed, patterns.where(F.col("trust") >= trust), "pattern", "degree", n, place, how="inner")
    more = placed.groupBy("row").agg(F.collect_set(F.struct(F.lit(FOUND).alias("kind"), "start", "end")).alias("found"))
    base = F.transform(F.filter("mentions", lambda m: m["kind"].isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    out = scanned.select("doc_id", "row_key", key, base.alias("base")).join(more, "row", "left")
    spans = F.concat("base", F.coalesce("found", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    return out.select("doc_id", "row_key", ordered(spans).alias("spans"))


def ordered(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    rank = F.array(*[F.lit(k) for k in (*KINDS, FOUND)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != FOUND)
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count(FOUND))


QUERIES = {"op7_personal_data": op7_personal_data}
ORACLES: dict[str, str] = {}
