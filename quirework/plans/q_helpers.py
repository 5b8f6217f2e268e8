"""Queries over the helpers: addresses, digests, media types, manifests, translation, SQL functions, audit lines."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import registry, urls
from quirework.functions import text as ft
from quirework.operators import layout
from quirework.operators import text as ot
from quirework.plans.fixtures import ctes, fixture
from quirework.plans.q_text import ORACLES as TEXT_ORACLES
from quirework.sources import readers
from quirework.streaming import jobs as s

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str, sql: str | None = None):
    def keep(f):
        tables = needs.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            seen: dict[str, DataFrame] = {}
            return f(*(fixture(spark, sf_dir, x, seen) for x in tables))

        QUERIES[name] = run
        if sql is not None:
            head, body = ctes(*tables), sql.strip()
            ORACLES[name] = f"{head}{body}" if body.startswith(",") and head else f"WITH {body[1:]}" if body.startswith(",") else f"{head} {body}"
        return f

    return keep


@query("flt11_public_urls", "pages", r"""SELECT page_id, host, reason FROM (SELECT page_id, CASE WHEN reason IS NULL THEN h END AS host, reason FROM (SELECT page_id, h, CASE WHEN NOT starts_with(u, 'https://') THEN 'not HTTPS' WHEN regexp_matches(u, '[?].') THEN 'query' WHEN regexp_matches(u, '#.') THEN 'fragment'
    WHEN ends_with(h, '.example') OR ends_with(h, '.test') OR ends_with(h, '.local') THEN 'not public' END AS reason FROM (SELECT page_id, u, lower(regexp_extract(u, '^https://([^/?#:]*)', 1)) AS h FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url || '?q=1' WHEN page_id % 7 = 0 THEN replace(url, 'https://', 'http://') ELSE url END AS u FROM pages))))""")
def _(web):
    url = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("?q=1"))).when(F.col("page_id") % 7 == 0, F.replace("url", F.lit("https://"), F.lit("http://"))).otherwise(F.col("url"))
    return urls.validate_urls(web.select("page_id", url.alias("url"))).select("page_id", "host", "reason")


def _pad(key: bytes, x: int) -> str:
    return "'" + "".join(f"\\x{b ^ x:02X}" for b in key.ljust(64, b"\0")) + "'::BLOB"


@query("txt15_keyed_digests", "customer", f"SELECT c_custkey, sha256({_pad(b'key', 0x5C)} || unhex(sha256({_pad(b'key', 0x36)} || encode(c_custkey || '.' || c_name)))) AS digest FROM customer")
def _(customer):
    return customer.select("c_custkey", ft.hmac_hex(F.concat(F.col("c_custkey").cast("string"), F.lit("."), "c_name"), b"key").alias("digest"))


@query("txt3_media_types", "documents", """SELECT doc_id, CASE WHEN text IS NOT NULL THEN CASE doc_id % 8 WHEN 0 THEN 'application/pdf' WHEN 2 THEN 'image/png' WHEN 3 THEN CASE WHEN strlen(text) <= 2097152 AND NOT regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN 'text/plain' END WHEN 5 THEN 'image/webp' END END AS content_type FROM documents""")
def _(documents):
    """Every document's whole text as a file: behind a header, plain, or with one bad byte at its end."""
    k, d, whole = F.col("doc_id") % 8, F.col("doc_id").cast("string"), F.col("text").cast("binary")
    ending = F.when(k == 0, ".PDF").when(k.isin(1, 2), ".png").when(k == 3, ".txt").when(k == 4, "").when(k == 5, ".webp").when(k == 6, ".md").otherwise(".csv")
    head = F.when(k.isin(0, 1), "255044462D312E370A").when(k == 2, "89504E470D0A1A0A").when(k == 5, "524946460000000057454250").otherwise("")
    last = F.when(k == 6, "00").when(k == 7, "FF").otherwise("")
    files = documents.select("doc_id", F.concat(F.lit("landing/f"), d, ending).alias("path"), F.concat(F.unhex(head), whole, F.unhex(last)).alias("content"))
    return readers.sniff_type(files).select("doc_id", "content_type")


@query("src5_ingested_files", "documents", "SELECT 'f' || doc_id || '.txt' AS original_name, strlen(text) AS size, sha256(text) AS sha256, CASE WHEN NOT regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN 'text/plain' END AS content_type FROM documents")
def _(documents):
    files = documents.select(F.concat(F.lit("file:/landing/f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    return readers.ingest_files(files, "src1", "2024-01-04 00:00:00").select("original_name", "size", "sha256", "content_type")


@query("str10_ingest_stream", "documents", """SELECT 'f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' WHEN 2 THEN '.png' ELSE '.csv' END AS original_name, CASE WHEN doc_id % 50 = 1 THEN 104857601 ELSE strlen(text) + CASE doc_id % 4 WHEN 0 THEN 9 ELSE 0 END END AS size,
        CASE WHEN doc_id % 50 = 1 OR doc_id % 4 = 2 OR (doc_id % 4 IN (1, 3) AND (strlen(text) > 2097152 OR regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]'))) THEN NULL ELSE CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' ELSE 'text/csv' END END AS content_type,
        CASE WHEN doc_id % 50 = 1 THEN 'too large' WHEN doc_id % 4 = 2 OR (doc_id % 4 IN (1, 3) AND (strlen(text) > 2097152 OR regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]'))) THEN 'name and content don''t agree' END AS reason, doc_id * 60 + 86400 AS expires FROM documents WHERE text IS NOT NULL""")
def _(documents):
    """Every text lands as a file of some kind; PNG files are none, and one in fifty says that it is too large."""
    spark, where, k = documents.sparkSession, folder(documents.sparkSession, "landing"), F.col("doc_id") % 4
    ending = F.when(k == 0, ".pdf").when(k == 1, ".txt").when(k == 2, ".png").otherwise(".csv")
    content = F.concat(F.when(k == 0, F.unhex(F.lit("255044462D312E370A"))).otherwise(F.unhex(F.lit(""))), F.col("text").cast("binary"))
    files = documents.where("text IS NOT NULL").select(F.concat(F.lit("landing/f"), F.col("doc_id").cast("string"), ending).alias("path"), F.timestamp_seconds(F.col("doc_id") * 60).alias("modificationTime"), F.when(F.col("doc_id") % 50 == 1, 104857601).otherwise(F.octet_length(content)).cast("long").alias("length"), content.alias("content"))
    files.write.parquet(f"{where}/in")
    landed = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").parquet(f"{where}/in")
    return s.run_once(s.ingest_landed(landed, "src1"), where).select("original_name", "size", "content_type", "reason", F.unix_timestamp("expires_at").alias("expires"))


@query("src6_csv_lines", "spans rules", "")
def _(spans, rules):
    cells = layout.assign_cells(spans, rules.select("page_id", "axis", *[F.col(c).cast("double").alias(c) for c in ("pos", "lo", "hi")]))
    return readers.csv_lines(cells)


ORACLES["src6_csv_lines"] = f"""WITH cells AS ({TEXT_ORACLES["join18_table_cells"]}), w AS (SELECT page_id, max(col) AS most FROM cells GROUP BY page_id),
    g AS (SELECT page_id, row, unnest(range(0, most + 1)) AS col FROM (SELECT DISTINCT page_id, row, most FROM cells JOIN w USING (page_id))),
    q AS (SELECT page_id, row, col, CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM cells)
    SELECT g.page_id, g.row, CASE WHEN g.row = 0 THEN chr(65279) ELSE '' END || string_agg(coalesce(cell, ''), ',' ORDER BY g.col) || chr(13) AS line
    FROM g LEFT JOIN q ON q.page_id = g.page_id AND q.row = g.row AND q.col = g.col GROUP BY g.page_id, g.row"""


@query("src7_manifest_audit", "documents", """, f AS (SELECT doc_id, CASE WHEN doc_id % 14 = 0 THEN 'XPDF-1.7' || chr(10) || text || chr(10) || '%%EOF' WHEN doc_id % 9 = 5 THEN '%PDF-1.7' || chr(10) || '%%EOF' || chr(10) || text ELSE '%PDF-1.7' || chr(10) || text || chr(10) || '%%EOF' END AS body FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS case_id, CASE WHEN doc_id % 10 = 0 OR body IS NULL THEN 'missing file' WHEN strlen(body) > 67108864 THEN 'wrong size' WHEN NOT starts_with(body, '%PDF-') OR NOT contains(hex(encode(body)[-4096:]), '2525454F46') THEN 'not a PDF' WHEN doc_id % 4 = 0 THEN 'checksum mismatch' ELSE 'ok' END AS status FROM f""")
def _(documents):
    """A case for each document, its whole text in both files; some have the end mark before the text, or a digest of other last bytes."""
    d, start, end = F.col("doc_id"), F.lit("%PDF-1.7\n"), F.lit("%%EOF")
    body = F.when(d % 14 == 0, F.concat(F.lit("XPDF-1.7\n"), "text", F.lit("\n"), end)).when(d % 9 == 5, F.concat(start, end, F.lit("\n"), "text")).otherwise(F.concat(start, "text", F.lit("\n"), end))
    both = documents.where((d % 10 != 0) & F.col("text").isNotNull()).select(F.explode(F.array(F.lit("s"), F.lit("o"))).alias("side"), d, body.alias("b"))
    files = both.select(F.concat(F.lit("/d/"), "side", d.cast("string")).alias("path"), F.octet_length("b").alias("length"), F.col("b").cast("binary").alias("content"))
    manifest = documents.select(d.cast("string").alias("case_id"), F.concat(F.lit("s"), d.cast("string")).alias("source"), F.concat(F.lit("o"), d.cast("string")).alias("output"), F.sha2(body, 256).alias("source_sha256"), F.sha2(F.when(d % 4 == 0, F.concat(body, F.lit("x"))).otherwise(body), 256).alias("output_sha256"))
    return readers.audit_manifest(manifest, files)


@query("txt13_filled_forms", "customer", """SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE c_custkey % 5 WHEN 0 THEN 'N' || c_custkey WHEN 4 THEN 'A' ELSE c_name END AS name, CASE c_custkey % 5 WHEN 4 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS nation,
    CASE c_custkey % 5 WHEN 1 THEN 'unknown field' WHEN 2 THEN '1 to 64 updates' WHEN 3 THEN 'value too long' END AS reason FROM customer""")
def _(customer):
    """A form for each customer; updates of one field, an unknown one, none, a long value, and all fields."""
    k, d = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    forms = customer.select(d.alias("doc_id"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("fields"))
    made = F.when(k == 0, F.create_map(F.lit("name"), F.concat(F.lit("N"), d))).when(k == 1, F.create_map(F.lit("other"), F.lit("x"))).when(k == 2, F.create_map().cast("map<string,string>"))
    made = made.when(k == 3, F.create_map(F.lit("name"), F.repeat(F.lit("x"), F.lit(1025)))).otherwise(F.create_map(F.lit("name"), F.lit("A"), F.lit("nation"), F.lit("")))
    out = ot.fill_form(forms, customer.select(d.alias("doc_id"), made.alias("updates")))
    return out.select("doc_id", F.col("fields")["name"].alias("name"), F.col("fields")["nation"].alias("nation"), "reason")


@query("udf1_operations", "doc_pages", "SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) || ' / ' || count(*) OVER (PARTITION BY doc_id) AS label FROM doc_pages")
def _(doc_pages):
    return registry.apply_operation("page-numbers", [doc_pages])


@query("udf2_translated_pages", "doc_pages", """, bad AS (SELECT DISTINCT doc_id FROM doc_pages WHERE length(text) > 11998 OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '') SELECT doc_id, page_no, sha256('t:' || text) AS target FROM doc_pages WHERE doc_id NOT IN (SELECT doc_id FROM bad)""")
def _(doc_pages):
    out = registry.translate_pages(doc_pages, lambda t, a, b: "t:" + t if t.strip() else "", "en", "th")
    return out.select("doc_id", "page_no", F.sha2("target_text", 256).alias("target"))


@query("udf3_sql_functions", "documents page_plans doc_pages", r""", n AS (SELECT doc_id, count(*) AS total FROM doc_pages GROUP BY doc_id)
    SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]{2,}|[\x{0e00}-\x{0e7f}]{2,}')) AS tokens, coalesce(CASE d.doc_id % 10 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN total >= 2 THEN 2 END WHEN 2 THEN CASE WHEN total >= 2 THEN 2 END WHEN 3 THEN CASE WHEN total <= 80 THEN total END WHEN 4 THEN CASE WHEN total <= 80 THEN total END WHEN 9 THEN 1 END, 0) AS pages FROM documents d LEFT JOIN n ON n.doc_id = CAST(d.doc_id AS VARCHAR)""")
def _(documents, plans, doc_pages):
    registry.register(documents.sparkSession)
    counts = doc_pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("total"))
    asked = plans.join(counts, "doc_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return documents.sparkSession.sql(
        """SELECT CAST(d.doc_id AS STRING) AS doc_id, size(doc_tokens(text)) AS tokens, coalesce(pages, 0) AS pages FROM {documents} d
           LEFT JOIN (SELECT doc_id, count(*) AS pages FROM {asked} a, LATERAL page_range(a.expression, a.total) GROUP BY doc_id) p ON p.doc_id = CAST(d.doc_id AS STRING)""",
        documents=documents, asked=asked,
    )


def folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quirework-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("src1_newest_audit_lines", "audit_events", """, l AS (SELECT *, 0 AS bad FROM audit_events UNION ALL SELECT *, 1 FROM audit_events WHERE event_id % 10 = 3)
    SELECT event, actor, resource_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM (SELECT * FROM l ORDER BY ts DESC, event_id DESC, bad DESC LIMIT 200) WHERE bad = 0""")
def _(audit):
    """The last 200 lines of a log in which every tenth event is followed by a blank and a broken line, which uses up the limit."""
    path = folder(audit.sparkSession, "audit")
    good = F.to_json(F.struct(F.col("ts").alias("timestamp"), "event", "actor", "resource_type", "resource_id"))
    broken = F.when(F.col("event_id") % 10 == 3, F.array(F.lit(" "), F.concat(F.lit('{"event": "'), F.col("event_id").cast("string"))))
    rows = audit.orderBy("ts", "event_id").select(F.explode(F.concat(F.array(good), F.coalesce(broken, F.array().cast("array<string>")))).alias("value"))
    rows.write.text(path)
    return readers.read_audit(audit.sparkSession, path, 200).select("event", "actor", "resource_id", F.unix_timestamp("timestamp").alias("at_s"))


@query("src2_written_audit_lines", "audit_events", "SELECT event, actor, resource_type, resource_id, CAST(epoch_us(ts) AS BIGINT) AS at_us, 0 AS details FROM audit_events")
def _(audit):
    """All events written as JSON Lines in two batches and read back."""
    path = folder(audit.sparkSession, "audit")
    lines = audit.select(F.col("ts").alias("timestamp"), "event", "actor", "resource_type", "resource_id", F.lit(None).cast("map<string,string>").alias("details"), "event_id")
    for batch in ("1", "2"):
        readers.write_audit(lines.where(F.col("event_id") % 2 == int(batch) % 2), path, batch)
    back = audit.sparkSession.read.schema(readers.AUDIT).option("recursiveFileLookup", "true").json(path)
    return back.select("event", "actor", "resource_type", "resource_id", F.unix_micros("timestamp").alias("at_us"), F.size("details").alias("details"))


@query("src4_declared_table", "files", "SELECT id, size, CAST(created_at AS VARCHAR) AS created_at FROM files")
def _(files):
    path = folder(files.sparkSession, "files")
    files.write.parquet(path)
    return readers.load_table(files.sparkSession, "files", path).select("id", "size", F.col("created_at").cast("string").alias("created_at"))
