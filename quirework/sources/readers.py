"""Sources and sinks: audit lines, storage listings, declared tables, landed files, page CSV, checksum audits."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions.text import safe_filename
from quirework.schemas import TABLES

AUDIT = "timestamp timestamp, event string, actor string, resource_type string, resource_id string, details map<string,string>"
MOST_BYTES = 100 * 1024 * 1024


def read_audit(spark: SparkSession, path: str, limit: int = 200) -> DataFrame:
    """SRC1: the last lines of an audit log that aren't blank; the limit counts lines before malformed ones are dropped.

    Lines stand in the order of their files' names, then of their place in the file, as write_audit() leaves them. Files
    are read from the newest backwards, four times as many until there are enough lines, so what is read doesn't grow
    with the log (but is whole files).
    """
    def lines_of(*paths: str) -> DataFrame:
        read = spark.read.option("recursiveFileLookup", "true").text(list(paths))
        return read.select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).where(F.btrim("value") != "")

    files = sorted(spark.read.option("recursiveFileLookup", "true").text(path).inputFiles(), reverse=True)
    take = 4
    while take < len(files) and lines_of(*files[:take]).limit(limit).count() < limit:
        take *= 4
    rows = lines_of(*files[:take]) if files else lines_of(path)
    last = rows.orderBy(F.desc("file_path"), F.desc("file_block_start"), F.desc("n")).limit(limit)
    return last.select(F.from_json("value", AUDIT).alias("e")).where(F.col("e.event").isNotNull()).select("e.*")


def write_audit(df: DataFrame, path: str, batch: str | None = None) -> None:
    """SRC2: append events as JSON Lines, in their order; details are never null. Batches are folders whose names ascend."""
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    out = df.select(iso.alias("timestamp"), "event", "actor", "resource_type", "resource_id", F.coalesce("details", F.create_map().cast("map<string,string>")).alias("details"))
    name = batch or f"{time.time_ns():020d}"
    out.write.mode("append").option("ignoreNullFields", "false").json(f"{path.rstrip('/')}/batch-{name}")


def list_storage(spark: SparkSession, root: str) -> DataFrame:
    """SRC3: the managed objects under root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    area = F.regexp_extract("path", "/(originals|processed)/([^/]+)$", 1)
    return files.where(area != "").select(area.alias("area"), F.regexp_extract("path", "([^/]+)$", 1).alias("stored_name"), F.col("path").alias("location"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))


def load_table(spark: SparkSession, name: str, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """SRC4: a table with its declared schema, from Parquet or by JDBC (options as of Spark's reader)."""
    if jdbc is not None:
        rows = spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])
    return spark.read.schema(TABLES[name]).parquet(path)


#: File endings, their media types and how such files begin.
SIGNATURES = [
    (("pdf",), "application/pdf", ["25504446 2D"]),
    (("png",), "image/png", ["89504E47 0D0A1A0A"]),
    (("jpg", "jpeg", "jfif"), "image/jpeg", ["FFD8FF"]),
    (("tif", "tiff"), "image/tiff", ["49492A00", "4D4D002A"]),
    (("bmp",), "image/bmp", ["424D"]),
    (("gif",), "image/gif", ["474946383761", "474946383961"]),
    (("doc",), "application/msword", ["D0CF11E0 A1B11AE1"]),
    (("xls",), "application/vnd.ms-excel", ["D0CF11E0 A1B11AE1"]),
    (("ppt",), "application/vnd.ms-powerpoint", ["D0CF11E0 A1B11AE1"]),
    (("rtf",), "application/rtf", ["7B5C727466"]),
]
TEXTS = {"txt": "text/plain", "csv": "text/csv", "md": "text/markdown"}


def begins(content: Column, hexes: list[str]) -> Column:
    tests = [F.hex(F.substring(content, 1, len(h.replace(" ", "")) // 2)) == h.replace(" ", "") for h in hexes]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def media_type(name: Column, content: Column) -> Column:
    """TXT3: the type that both the name's ending and the content agree on, else NULL."""
    ending = F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))
    out = F.when(F.lit(False), F.lit(""))
    for endings, kind, hexes in SIGNATURES:
        out = out.when(ending.isin(*endings) & begins(content, hexes), kind)
    out = out.when((ending == "webp") & begins(content, ["52494646"]) & (F.hex(F.substring(content, 9, 4)) == "57454250"), "image/webp")
    text = F.try_validate_utf8(content.cast("string"))
    clean = (F.octet_length(content) <= 2 * 1024 * 1024) & text.isNotNull() & ~text.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]")
    for e, kind in TEXTS.items():
        out = out.when((ending == e) & clean, kind)
    return out


def sniff_type(files: DataFrame, name: str = "path") -> DataFrame:
    """TXT3: content_type and, where it is NULL, reason."""
    kind = media_type(F.col(name), F.col("content"))
    return files.withColumn("content_type", kind).withColumn("reason", F.when(kind.isNull(), "name and content don't agree"))


def file_records(files: DataFrame, owner: str, at: Column, hours: int = 24) -> DataFrame:
    """Records of landed files (binaryFile rows), without their content; too large or mistyped ones have a reason and no type."""
    typed = sniff_type(files)
    reason = F.when(F.col("length") > MOST_BYTES, "too large").otherwise(F.col("reason"))
    return typed.select(
        safe_filename("path").alias("original_name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.when(reason.isNull(), F.col("content_type")).alias("content_type"),
        F.lit(owner).alias("source_system"), at.alias("created_at"), (at + F.expr(f"INTERVAL {hours} HOURS")).alias("expires_at"), reason.alias("reason"),
    )


def ingest_files(files: DataFrame, owner: str, now, hours: int = 24) -> DataFrame:
    """SRC5: file_records() of files that land now."""
    return file_records(files, owner, F.lit(now).cast("timestamp"), hours)


def csv_lines(cells: DataFrame) -> DataFrame:
    r"""SRC6: one line per table row, in grid order, minimally quoted, ended by \r\n; the first has a byte order mark."""
    value = F.coalesce("text", F.lit(""))
    quoted = F.when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)
    width = cells.groupBy("page_id").agg((F.max("col") + 1).alias("width"))
    rows = cells.groupBy("page_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", quoted))).alias("m")).join(width, "page_id")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))), ",")
    return rows.select("page_id", "row", F.concat(F.when(F.col("row") == 0, "\ufeff").otherwise(""), line, F.lit("\r")).alias("line"))


def write_page_csv(cells: DataFrame, path: str) -> None:
    """SRC6: a folder per page with one text file; Spark adds the line feed."""
    lines = csv_lines(cells).repartition("page_id").sortWithinPartitions("page_id", "row")
    lines.select("page_id", F.col("line").alias("value")).write.partitionBy("page_id").mode("overwrite").text(path)


def audit_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """SRC7: case_id and status: ok, duplicate case, missing file, wrong size, not a PDF or checksum mismatch."""
    content = F.col("content")
    facts = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", F.sha2(content, 256).alias("sha"), (begins(content, ["255044462D"]) & (F.instr(F.hex(F.expr("substring(content, -4096)")), "2525454F46") > 0)).alias("is_pdf"))
    cases = manifest.withColumn("again", F.count("*").over(Window.partitionBy("case_id")) > 1)
    sides = cases.select("case_id", "again", F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("source_sha256").alias("wanted")), F.struct(F.col("output").alias("name"), F.col("output_sha256").alias("wanted")))).alias("s")).select("case_id", "again", "s.*")
    seen = sides.join(facts, "name", "left")
    rank = (
        F.when(F.col("again"), F.struct(F.lit(1), F.lit("duplicate case")))
        .when(F.col("sha").isNull(), F.struct(F.lit(2), F.lit("missing file")))
        .when(~F.col("length").between(1, 64 * 1024 * 1024), F.struct(F.lit(3), F.lit("wrong size")))
        .when(~F.col("is_pdf"), F.struct(F.lit(4), F.lit("not a PDF")))
        .when(F.col("sha") != F.lower("wanted"), F.struct(F.lit(5), F.lit("checksum mismatch")))
        .otherwise(F.struct(F.lit(9), F.lit("ok")))
    )
    return seen.groupBy("case_id").agg(F.min(rank)["col2"].alias("status"))
