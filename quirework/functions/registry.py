"""UDF1-3: operations by name, page translation with a caller's function, and SQL functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import TOKEN
from quirework.operators import pages, text

#: name: (transform, least and most inputs)
OPERATIONS: dict[str, tuple[Callable[..., DataFrame], int, int]] = {
    "merge": (pages.merge_documents, 2, 2),
    "split": (pages.split_parts, 1, 1),
    "organize": (pages.organize_pages, 2, 2),
    "rotate": (pages.rotate_pages, 2, 2),
    "delete-pages": (pages.delete_pages, 2, 2),
    "page-numbers": (pages.page_labels, 1, 1),
    "stamp": (pages.place_stamp, 1, 1),
    "images-to-pdf": (pages.fit_images, 1, 1),
    "summary": (text.extractive_summary, 1, 1),
    "evidence": (text.evidence, 2, 2),
    "transcript": (text.transcript, 1, 1),
}


def apply_operation(name: str, inputs: list[DataFrame], **params) -> DataFrame:
    """UDF1: an unknown name or a wrong number of inputs fails."""
    if name not in OPERATIONS:
        raise ValueError(f"unsupported operation: {name}")
    f, least, most = OPERATIONS[name]
    if not least <= len(inputs) <= most:
        raise ValueError(f"{name} takes {least} to {most} inputs")
    return f(*inputs, **params)


PAIRS = {("en", "th"), ("th", "en")}
CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def translate_pages(doc_pages: DataFrame, fn: Callable[[str, str, str], str], source: str, target: str) -> DataFrame:
    """UDF2: doc_id, page_no, source_text, target_text of the documents all of whose pages come back usable."""
    if (source, target) not in PAIRS:
        raise ValueError("translates between en and th")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["source_text"]:
                try:
                    reply = fn(t, source, target)
                except Exception:
                    reply = None
                good = isinstance(reply, str) and reply.strip() and len(reply) <= 12_000 and not CONTROLS.search(reply)
                out.append(reply if good else None)
            yield b.assign(target_text=out)

    rows = doc_pages.select("doc_id", "page_no", F.col("text").alias("source_text"))
    done = rows.repartition("doc_id", "page_no").mapInPandas(run, "doc_id string, page_no int, source_text string, target_text string")
    whole = done.groupBy("doc_id").agg(F.count_if(F.col("target_text").isNull()).alias("bad")).where("bad = 0").select("doc_id")
    return done.join(whole, "doc_id", "left_semi")


def register(spark: SparkSession) -> None:
    """UDF3: doc_tokens, hmac_hex, page_list and the table function page_range, as temporary functions of Spark SQL."""
    key = "CASE WHEN octet_length(k) > 64 THEN sha2(k, 256) ELSE hex(k) END"
    pad = "unhex(array_join(transform(sequence(0, 63), i -> lpad(hex(CAST(conv(coalesce(nullif(substr({key}, 2 * i + 1, 2), ''), '0'), 16, 10) AS BIGINT) ^ {x}), 2, '0')), ''))"
    inner, outer = (pad.format(key=key, x=x) for x in (0x36, 0x5C))
    number = "CASE WHEN {0} = 'z' THEN total ELSE try_cast({0} AS INT) END"
    ends = f"transform(split(expression, ','), p -> struct({number.format('split(p, \'-\')[0]')} AS a, {number.format('element_at(split(p, \'-\'), -1)')} AS b))"
    inside = f"forall({ends}, e -> e.a BETWEEN 1 AND total AND e.b BETWEEN 1 AND total)"
    listed = f"flatten(transform({ends}, e -> sequence(e.a, e.b)))"
    fine = f"length(expression) BETWEEN 1 AND 256 AND expression RLIKE '{pages.RANGE}' AND total BETWEEN 1 AND {pages.MOST_PAGES} AND {inside}"
    pages_ = f"CASE WHEN {fine} THEN CASE WHEN size({listed}) <= {pages.MOST_PARTS} AND size(array_distinct({listed})) = size({listed}) THEN {listed} END END"
    for text_ in (
        f"doc_tokens(s STRING) RETURNS ARRAY<STRING> RETURN transform(regexp_extract_all(coalesce(s, ''), '{TOKEN}', 0), t -> lower(t))",
        f"hmac_hex(s STRING, k STRING) RETURNS STRING RETURN sha2(concat({outer}, unhex(sha2(concat({inner}, CAST(s AS BINARY)), 256))), 256)",
        f"page_list(expression STRING, total INT) RETURNS ARRAY<INT> RETURN {pages_}",
        f"page_range(expression STRING, total INT) RETURNS TABLE(ordinal INT, page INT) RETURN SELECT e.pos + 1, e.col FROM (SELECT {pages_} AS l) p, LATERAL posexplode(p.l) AS e(pos, col)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text_}")
