"""Exact duplicates by content-defined chunk recipes.

A text is cut where its content says so (after a line or sentence end, 256 to 4096 characters a chunk), so equal
texts give equal chunks. A chunk's identifier is its 64-bit hash. Equal hashes are verified: all distinct
(hash, chunk) pairs meet once, and a hash that stands for two different chunks is ambiguous; such a chunk is
identified by its own characters instead. A document's recipe is the ordered list of identifiers; two texts are
equal if and only if their recipes are. From then on only recipes travel, never documents.

Rules: a null text counts as empty; empty texts are equal to each other. Of equal texts the row with the largest
doc_id stays; a null doc_id is smaller than any other. Rows that repeat doc_id and text share one decision. Extra
columns are passed through by drop_copies() and may not be named like the added ones (keep_id, group_size, kept). An
empty table gives an empty one; a very long text is as many chunks as it takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import attach_groups, fresh, one_of_repeats, table

CHUNKS = r"(?s).{256,4096}?(?:(?<=\n)|(?<=[.!?] )|\z)|.{1,4096}"
#: With a 64-bit hash, n chunks give about n * n / 2**65 ambiguous hashes: some 300 for 100 TB. More are a fault.
MOST_AMBIGUOUS = 100_000


def chunks(text: Column) -> Column:
    """The ordered chunks of a text; together they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CHUNKS), F.lit(0))


def chunk_table(docs: DataFrame, text: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per distinct (hash, chunk), with its number of uses. The chunks move once; copies merge before that."""
    pieces = docs.select(F.explode(chunks(F.col(text))).alias("chunk"))
    return pieces.groupBy(chunk_hash(F.col("chunk")).alias("chunk_id"), "chunk").agg(F.count("*").alias("uses"))


def ambiguous_hashes(docs: DataFrame, text: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64) -> list[int]:
    """Hashes that stand for several chunks; next to none, see MOST_AMBIGUOUS."""
    twice = chunk_table(docs, text, chunk_hash).groupBy("chunk_id").count().where("count > 1")
    found = [r[0] for r in twice.select("chunk_id").limit(MOST_AMBIGUOUS + 1).collect()]
    if len(found) > MOST_AMBIGUOUS:
        raise ValueError("the chunk hash is not fit for use: too many chunks share a hash")
    return found


def with_recipe(docs: DataFrame, text: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64, name: str = "recipe") -> DataFrame:
    """Add, under that name, the verified identifiers of the text's chunks, in order."""
    doubtful = ambiguous_hashes(docs, text, chunk_hash)
    whole = chunks(F.col(text))
    parts = [F.transform(whole, lambda c: chunk_hash(c)).alias("ids")]
    if doubtful:
        parts.append(F.filter(whole, lambda c: chunk_hash(c).isin(doubtful)).alias("spelled_out"))
    return docs.withColumn(name, F.struct(*parts))


def find_copies(docs: DataFrame, text: str = "text", carry: list[str] | None = None, chunk_hash: Callable[[Column], Column] = F.xxhash64, added: tuple[str, str, str] = ("keep_id", "group_size", "kept")) -> DataFrame:
    """doc_id, the carried columns, keep_id, group_size and kept (or what they are to be named) for each row."""
    carry = carry or []
    keep_id, group_size, kept = added
    (recipe,) = fresh([*docs.columns, *added], "recipe")
    rows = with_recipe(docs, text, chunk_hash, recipe).select("doc_id", *[F.col(f"`{c}`") for c in carry], recipe)
    groups = rows.groupBy(recipe).agg(F.max("doc_id").alias(keep_id), F.count("*").alias(group_size))
    other = F.struct(F.array(F.xxhash64("doc_id")).alias("ids"), *([F.array().cast("array<string>").alias("spelled_out")] if "spelled_out" in rows.schema[recipe].dataType.names else []))
    found = attach_groups(rows, groups, recipe, group_size, docs.count(), other)
    return found.withColumn(kept, F.col("doc_id").eqNullSafe(F.col(keep_id))).drop(recipe)


def drop_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with."""
    added = tuple(fresh(docs.columns, "keep_id", "group_size", "kept"))
    names = [c for c in docs.columns if c != "doc_id"]
    found = find_copies(docs, text, names, added=added).where(F.col(added[2])).select(*[F.col(f"`{c}`") for c in docs.columns])
    return one_of_repeats(found, "doc_id", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return find_copies(docs, "text", ["text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)"""
}
