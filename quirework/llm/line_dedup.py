"""Cross-site boilerplate lines, found by the spread of their sites.

Each line (trimmed, not blank) is hashed and counted per site, so a line that a third of all documents hold becomes
one row per site before anything else. A HyperLogLog sketch of its sites is then built and merged per hash by plain
aggregation. Lines that are clearly at or above min_sites sites are boilerplate; those whose estimate lies within the
sketch's error of it get an exact distinct count. Boilerplate lines are removed from every document.

Rules: a null text has no lines; an empty one has one blank line. Blank lines count but are never removed. A null site
is a site of its own. Rows that repeat doc_id and text get the same result. Extra columns are passed through by
drop_boilerplate(); they may have any name but those of the added ones (n_lines, n_removed, kept_text). An empty table
gives an empty one; a very long text is cut into all its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import attach_groups, fresh, table, written

BLANKS = " \t\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(docs: DataFrame, text: str, site: str) -> DataFrame:
    """doc_id, text_hash, site, line number and hash of each line that isn't blank."""
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    trimmed = F.btrim("line", F.lit(BLANKS))
    return rows.where(trimmed != "").select("doc_id", "text_hash", "site", "pos", F.xxhash64(trimmed).alias("line_hash"))


def per_site(lines: DataFrame) -> DataFrame:
    """line_hash, site and how many lines there are of them."""
    return lines.groupBy("line_hash", "site").agg(F.count("*").alias("n"))


def boilerplate(sited: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """line_hash and n_rows of the lines that stand on min_sites sites or more, from rows of per_site()."""
    margin = max(1.5, 5 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    spread = sited.groupBy("line_hash").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.sum("n").alias("n_rows"))
    spread = spread.where(F.col("n_rows") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch"))
    sure = spread.where(F.col("sites") > min_sites + margin).select("line_hash", "n_rows")
    near = spread.where(F.abs(F.col("sites") - min_sites) <= margin).select("line_hash")
    exact = sited.join(near, "line_hash", "left_semi").groupBy("line_hash").agg(F.count("*").alias("sites"), F.sum("n").alias("n_rows"))
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("line_hash", "n_rows"))


def drop_boilerplate(docs: DataFrame, min_sites: int = 8, text: str = "text", site: str = "source") -> DataFrame:
    """docs with n_lines, n_removed and kept_text."""
    lines = line_rows(docs, text, site)
    sited = written(per_site(lines), "lines-per-site")
    total = sited.agg(F.sum("n")).first()[0] or 0
    marks = attach_groups(lines.drop("site"), boilerplate(sited, min_sites), "line_hash", "n_rows", total, F.xxhash64("doc_id", "text_hash", "pos"), how="inner")
    gone, key, mark, all_ = fresh([*docs.columns, "n_lines", "n_removed", "kept_text"], "gone", "key", "mark", "lines")
    found = marks.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias(gone)).withColumnsRenamed({"doc_id": key, "text_hash": mark})
    held = docs.join(found, docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs[text]) == F.col(mark)), "left").withColumn(all_, lines_of(F.col(text)))
    places = F.sequence(F.lit(0), F.size(all_) - 1)
    kept = F.transform(F.array_except(places, F.col(gone)), lambda i: F.get(F.col(all_), i))
    counts = [F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long").alias(n) for c, n in ((all_, "n_lines"), (gone, "n_removed"))]
    return held.select(*[F.col(f"`{c}`") for c in docs.columns], *counts, F.when(F.col(gone).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"))


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return drop_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op2_line_spread": op2_line_spread}
ORACLES = {
    "op2_line_spread": r"""
        WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
             t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
             b AS (SELECT k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce(source, chr(0))) >= 8),
             r AS (SELECT doc_id, count(*) AS n_lines, count(b.k) AS n_removed, coalesce(string_agg(CASE WHEN b.k IS NULL THEN line END, chr(10) ORDER BY i), '') AS kept
                   FROM t LEFT JOIN b USING (k) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN r USING (doc_id)"""
}
