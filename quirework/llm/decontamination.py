r"""Benchmark decontamination by size-partitioned MinHash containment search.

Words are runs of letters and digits in lower case; a set holds the distinct shingles of five words. An item of n
shingles counts as contained in a document that has 80 % of them or more. Items are partitioned by size (powers of
two). In each partition an item's sketch is its k smallest shingle hashes: k is one more than the shingles that a
containing document may lack, so small items can't be missed, and at most 16 for large ones, of which then four must
be found (a document that holds 80 % fails this once in 4 million cases). A document is asked for the sketch values with
all its shingles, since the minima of a long document say nothing about a short part of it, but only in the partitions
whose items are small enough for it to hold. Pairs that are found are verified on the exact shingle strings of both
texts.

The sketches, 16 numbers an item at most, are broadcast while the benchmark has under MOST_ITEMS items, and joined
by shuffle beyond that.

Rules: null or wordless texts have no shingles. A text of fewer than five words has its word sequence as its one
shingle. A null doc_id is a document like others. Rows that repeat a doc_id are searched each; a pair's figures are
those of the best row. Items that repeat an item_id and text are one; a null item_id is an item like others. Extra
columns of any name pass through drop_contaminated(). An empty table of documents or items gives no pair and drops
nothing; a very long text asks with all its shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import cut, fresh, table

MOST_ITEMS = 100_000
SKETCH, LEAST_HITS = 16, 4
#: A set of row keys below this number is broadcast (16 MB at most).
SMALL_KEYS = 1_000_000


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, size: int = 5) -> Column:
    """One hash per shingle, repeats included."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))
    return F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(F.lit("short"), F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def shingles(words: Column, size: int = 5) -> Column:
    """The distinct shingles as strings."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(size)]))
    return F.array_distinct(F.when(n >= size, many).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>")))


def sketches(items: DataFrame, percent: int, size: int = 5) -> DataFrame:
    """item, least (the smallest size of its partition), sketch value and the hits needed."""
    sets = items.select("item", word_list(F.col("text")).alias("words")).select("item", F.array_sort(F.array_distinct(shingle_hashes(F.col("words"), size))).alias("hashes"))
    sized = sets.withColumn("n", F.size("hashes")).where("n > 0")
    # the largest size of the partition decides, so that all its items have sketches of one length
    sized = sized.withColumn("least", F.pow(F.lit(2), F.floor(F.log2("n"))).cast("int")).withColumn("largest", F.col("least") * 2 - 1)
    lacking = F.floor(F.col("largest") * (100 - percent) / 100).cast("int")
    sized = sized.withColumn("k", F.least(F.lit(SKETCH), lacking + 1)).withColumn("hits", F.when(F.col("k") < SKETCH, 1).otherwise(LEAST_HITS))
    return sized.select("item", "least", "hits", F.explode(F.slice("hashes", F.lit(1), F.col("k"))).alias("hash"))


def row_key(docs: DataFrame) -> Column:
    """What tells rows apart: the doc_id and a hash of the text."""
    return F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"))


def candidates(docs: DataFrame, items: DataFrame, percent: int, size: int = 5) -> DataFrame:
    """row, item pairs worth verifying."""
    asked = sketches(items, percent, size)
    few = items.count() < MOST_ITEMS
    words = docs.select(row_key(docs).alias("row"), word_list(F.col("text")).alias("words"))
    hashed = words.select("row", F.greatest(F.size("words") - size + 1, F.lit(1)).alias("room"), F.explode(shingle_hashes(F.col("words"), size)).alias("hash"))
    hashes = hashed.select("row", "room", "hash")
    # a document has room for the items of a partition if it has percent of the smallest's shingles
    fits = (hashes["hash"] == asked["hash"]) & (F.col("least") * percent <= F.col("room") * 100)
    found = hashes.join(F.broadcast(asked) if few else asked, fits).select("row", "item", asked["hash"], "hits")
    return found.groupBy("row", "item").agg(F.count_distinct("hash").alias("n"), F.max("hits").alias("hits")).where("n >= hits").select("row", "item")


def find_contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """row (doc_id and a hash of its text), doc_id, item_id, shared, item_shingles, containment for each row and item it contains."""
    items = items.select("item_id", "text").dropDuplicates()
    items = items.withColumn("item", F.struct("item_id", F.xxhash64("text").alias("text_hash")))
    docs = docs.select("doc_id", "text")
    pairs = cut(candidates(docs, items, percent, size))
    keys = cut(pairs.select("row").distinct())
    few = keys.count() < SMALL_KEYS
    held = docs.withColumn("row", row_key(docs)).join(F.broadcast(keys) if few else keys, "row", "left_semi").dropDuplicates(["row"])
    held = held.select("row", "doc_id", word_list(F.col("text")).alias("words")).select("row", "doc_id", shingles(F.col("words"), size).alias("doc_set"))
    sets = items.select("item", "item_id", word_list(F.col("text")).alias("words")).select("item", "item_id", shingles(F.col("words"), size).alias("item_set"))
    both = pairs.join(sets, "item").join(held, "row")
    both = both.withColumn("shared", F.size(F.array_intersect("doc_set", "item_set")).cast("long")).withColumn("item_shingles", F.size("item_set").cast("long"))
    return both.where(F.col("shared") * 100 >= F.col("item_shingles") * percent).select("row", "doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The rows that contain no item."""
    hit = cut(find_contaminated(docs, items, percent).select("row").distinct())
    few = hit.count() < SMALL_KEYS
    (key,) = fresh(docs.columns, "row")
    hit = hit.withColumnRenamed("row", key)
    return docs.withColumn(key, row_key(docs)).join(F.broadcast(hit) if few else hit, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "shared", "item_shingles")).alias("b"))
    return best.select("doc_id", "item_id", "b.shared", "b.item_shingles", "b.containment")


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLES = {
    "op5_decontamination": r"""
        WITH t AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
             w AS (SELECT side, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM t),
             s AS (SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
             i AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM s WHERE side = 'i'),
             p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, any_value(i.n) AS item_shingles
                   FROM s d JOIN i ON d.g = i.g WHERE d.side = 'd' GROUP BY d.id, i.id)
        SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment FROM p WHERE shared * 100 >= item_shingles * 80"""
}
