"""The domain tables, derived from the star-schema, event and document tables.

Each table is one SQL text; what the two engines spell differently is behind the functions of a dialect. Spark gets
a DataFrame from fixture(), DuckDB a list of common table expressions from ctes().
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The clock of all queries.
NOW = "2024-01-04 00:00:00"
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "conversations", "pages")
OPERATIONS = ("organize", "split", "rotate", "watermark", "page-numbers", "stamp", "merge", "compress", "images-to-pdf", "ocr", "pdfa", "office-to-pdf", "pdf-to-images")


class SparkSQL:
    minutes = staticmethod(lambda n: f"timestampadd(MINUTE, CAST({n} AS INT), TIMESTAMP '2024-01-01 00:00:00')")
    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    json_list = staticmethod(lambda x: f"concat('[\"', array_join(sort_array(collect_set({x})), '\",\"'), '\"]')")
    pages = """SELECT CAST(doc_id AS STRING) AS doc_id, p + 1 AS page_no, page AS text, 595D AS width, 842D AS height, 0 AS rotation FROM (
        SELECT doc_id, posexplode(transform(sequence(0, (size(lines) - 1) div 10), i -> array_join(slice(lines, i * 10 + 1, 10), '\\n'))) AS (p, page)
        FROM (SELECT doc_id, split(text, '\\n', -1) AS lines FROM documents WHERE text IS NOT NULL))"""
    sentences = """SELECT conv_id, turn, i, s AS question FROM (SELECT conv_id, turn, posexplode(split(regexp_replace(text, '([.!?])[ \\t]+', '$1\n'), '[\r\n]+', -1)) AS (i, s) FROM conversations WHERE role = 'user')"""
    quantile = staticmethod(lambda x, q: f"percentile({x}, {q})")
    millis = staticmethod(lambda x: f"unix_millis({x})")
    #: Times from 2024 on, so many times as dense.
    squeezed = staticmethod(lambda x, n: f"timestamp_micros(1704067200000000 + (unix_micros(CAST({x} AS TIMESTAMP)) - 1704067200000000) DIV {n})")
    double = "DOUBLE"


class DuckSQL:
    minutes = staticmethod(lambda n: f"(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({n} AS BIGINT)))")
    sha = staticmethod(lambda x: f"sha256({x})")
    json_list = staticmethod(lambda x: f"'[\"' || string_agg(DISTINCT {x}, '\",\"' ORDER BY {x}) || '\"]'")
    pages = """SELECT CAST(doc_id AS STRING) AS doc_id, CAST(p + 1 AS INTEGER) AS page_no, array_to_string(lines[p * 10 + 1:p * 10 + 10], chr(10)) AS text, 595.0::DOUBLE AS width, 842.0::DOUBLE AS height, 0 AS rotation FROM (
        SELECT doc_id, lines, unnest(range(0, (len(lines) - 1) // 10 + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))"""
    sentences = """SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS question FROM (SELECT conv_id, turn, string_split_regex(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), '[\\r\\n]+') AS l FROM conversations WHERE role = 'user')"""
    quantile = staticmethod(lambda x, q: f"quantile_cont({x}, {q})")
    millis = staticmethod(lambda x: f"epoch_us({x}) // 1000")
    squeezed = staticmethod(lambda x, n: f"make_timestamp(1704067200000000 + (epoch_us({x}) - 1704067200000000) // {n})")
    double = "DOUBLE"


def _uuid(key: str) -> str:
    h = f"md5(CAST({key} AS STRING))"
    return f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', substr({h}, 17, 4), '-', substr({h}, 21, 12))"


def _operation(key: str) -> str:
    return f"CASE {key} % 13 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(OPERATIONS)) + " END"


_CELLS = " UNION ALL ".join(["SELECT 0 AS cell", *(f"SELECT {i}" for i in range(1, 24))])
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
#: name: (tables it needs, SQL by dialect)
#: Parameters that break or just keep the rules of some operation.
_PARAMS = [
    '{"text":"x","font_size":200,"opacity":0.01,"rotation":181,"position":"left"}',
    '{"text":"","margin":241,"opacity":1.0,"position":"top-left","rotation":-180}',
    '{"format":"gif","first_page":0,"last_page":"x"}',
    '{"format":"","start_number":-1,"font_size":6}',
    '{"scale":0.9,"position":"center","margin":0}',
    '{"page_size":"a3","fit":"fill","dpi":72.5,"scale":0.03}',
    '{"languages":"TH!","deskew":"maybe","rotate_pages":true,"start_number":1000000}',
    '{"pages":"1-z","degrees":-90,"format":"jpeg","last_page":100001,"page_size":"letter"}',
]


def _params(n: str) -> str:
    return f"CASE {n} % {len(_PARAMS)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_PARAMS)) + " END"


FIXTURES: dict[str, tuple[tuple[str, ...], Callable]] = {
    "n_docs": (("documents",), lambda d: "SELECT count(*) AS n FROM documents"),
    "files": (("documents",), lambda d: f"""SELECT CAST(doc_id AS STRING) AS id,
        concat(lang, ' Report ', CAST(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.jpg' ELSE '.docx' END) AS original_name,
        concat(CASE WHEN doc_id % 19 = 0 THEN 's3:' WHEN doc_id % 23 = 0 THEN 'sub/' ELSE '' END, 'obj-', CAST(doc_id AS STRING)) AS stored_name,
        CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' ELSE '{DOCX}' END AS content_type,
        n_chars AS size, {d.sha("text")} AS sha256, source AS source_system, {d.minutes("doc_id * 7")} AS created_at,
        CASE WHEN doc_id % 5 <> 0 THEN {d.minutes("doc_id * 7 + 1440")} END AS expires_at FROM documents"""),
    "storage_objects": (("documents", "part"), lambda d: f"""SELECT 'originals' AS area, concat('obj-', CAST(doc_id AS STRING)) AS stored_name, concat('originals/obj-', CAST(doc_id AS STRING)) AS location,
            n_chars + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size, {d.minutes("doc_id * 7")} AS modified_at FROM documents WHERE doc_id % 11 <> 0
        UNION ALL SELECT 'processed', concat('obj-', CAST(doc_id AS STRING)), concat('processed/obj-', CAST(doc_id AS STRING)), n_chars, {d.minutes("doc_id * 7")} FROM documents WHERE doc_id % 17 = 0
        UNION ALL SELECT 'processed', concat('part-', CAST(p_partkey AS STRING)), concat('processed/part-', CAST(p_partkey AS STRING)), CAST(1 AS BIGINT), {d.minutes("p_partkey")} FROM part"""),
    "job_inputs": (("lineitem", "n_docs"), lambda d: f"""SELECT l_orderkey, {d.json_list("CAST(l_partkey % n AS STRING)")} AS ids,
            CAST(min(CASE WHEN l_linenumber = 1 THEN l_partkey % n END) AS STRING) AS first_id FROM lineitem CROSS JOIN n_docs GROUP BY l_orderkey"""),
    "jobs": (("orders", "job_inputs"), lambda d: f"""SELECT {_uuid("o_orderkey")} AS id, {_operation("o_orderkey")} AS operation, status, CASE status WHEN 'completed' THEN 100 WHEN 'running' THEN 40 ELSE 0 END AS progress,
            coalesce(ids, '[]') AS input_file_ids_json, CASE WHEN status = 'completed' AND o_orderkey % 4 <> 0 THEN first_id END AS output_file_id,
            CASE WHEN o_orderkey % 6 = 0 THEN '{{"pages":"0,1"}}' WHEN o_orderkey % 6 = 1 THEN '{{"pages":"1-3,z","dpi":300}}' WHEN o_orderkey % 6 = 2 THEN '{{"degrees":45,"dpi":20}}' WHEN o_orderkey % 6 = 3 THEN '{{bad' WHEN o_orderkey % 6 = 4 THEN {_params("CAST(floor(o_orderkey / 6) AS BIGINT)")} ELSE '{{}}' END AS params_json,
            CASE WHEN status = 'failed' THEN 'engine error' END AS error, concat('src', CAST(o_custkey % 20 AS STRING)) AS requested_by, concat('rq-', CAST(o_orderkey AS STRING)) AS rq_job_id,
            CAST(o_orderkey % 3 + 1 AS INT) AS lease_epoch, CASE WHEN status = 'running' THEN concat('tok-', CAST(o_orderkey AS STRING)) END AS lease_token,
            CASE WHEN status = 'running' THEN {d.minutes("o_orderkey % 5000")} END AS lease_expires_at,
            {d.minutes("o_orderkey * 3 % 5760")} AS created_at, CASE WHEN status <> 'queued' THEN {d.minutes("o_orderkey * 3 % 5760 + o_orderkey % 9")} END AS started_at,
            CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN {d.minutes("o_orderkey * 3 % 5760 + o_orderkey % 9 + o_orderkey % 50")} END AS finished_at, o_orderkey
        FROM (SELECT *, CASE WHEN o_orderkey % 101 = 0 THEN 'queued' WHEN o_orderkey % 103 = 0 THEN 'running' WHEN o_orderkey % 29 = 0 THEN 'cancelled' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'completed' END AS status FROM orders) o
        LEFT JOIN job_inputs i ON o.o_orderkey = i.l_orderkey"""),
    "artifacts": (("lineitem", "n_docs"), lambda d: f"""SELECT {_uuid("l_orderkey")} AS job_id, CAST(l_partkey % n AS STRING) AS file_id, CASE WHEN l_linenumber = 1 THEN 'bundle' ELSE 'part' END AS role,
            CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber - 1 AS INT) END AS ordinal FROM lineitem CROSS JOIN n_docs"""),
    "outputs": (("lineitem",), lambda d: "SELECT l_orderkey AS o, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS n, l_partkey AS p FROM lineitem"),
    "made_files": (("outputs",), lambda d: f"""SELECT concat('f-', CAST(o AS STRING), '-', CAST(n AS STRING)) AS id, concat('out-', CAST(n AS STRING), '.bin') AS original_name, CASE WHEN n = 1 AND o % 17 <> 0 THEN 'application/zip' ELSE 'image/png' END AS content_type,
            CAST(p AS BIGINT) AS size, {d.sha("concat(CAST(o AS STRING), '-', CAST(n AS STRING))")} AS sha256, CASE WHEN o % 41 = 0 AND n = 2 THEN 'stranger' ELSE concat('src', CAST(o % 20 AS STRING)) END AS source_system, CASE WHEN o % 3 = 0 THEN {d.minutes("o % 5000")} END AS expires_at FROM outputs WHERE o % 37 <> 0 OR n <> 3"""),
    "made_jobs": (("outputs",), lambda d: f"""SELECT concat('job-', CAST(o AS STRING)) AS id, {_operation("o")} AS operation, CASE WHEN o % 53 = 0 THEN 'running' ELSE 'completed' END AS status,
            CASE WHEN o % 59 = 0 THEN NULL WHEN o % 43 = 0 THEN 'f-other' ELSE concat('f-', CAST(o AS STRING), '-1') END AS output_file_id, concat('src', CAST(o % 20 AS STRING)) AS requested_by FROM (SELECT DISTINCT o FROM outputs)"""),
    "made_artifacts": (("outputs",), lambda d: """SELECT concat('job-', CAST(o AS STRING)) AS job_id, concat('f-', CAST(o AS STRING), '-', CAST(n AS STRING)) AS file_id, CASE WHEN o % 29 = 0 AND n = 2 THEN 'thumbnail' WHEN n = 1 AND o % 5 = 0 THEN 'result' WHEN n = 1 THEN 'bundle' ELSE 'part' END AS role,
            CASE WHEN n = 1 AND o % 31 = 0 THEN 1 WHEN n = 1 THEN NULL WHEN o % 23 = 0 THEN n ELSE n - 1 END AS ordinal FROM outputs WHERE o % 47 <> 0"""),
    "write_journal": (("outputs",), lambda d: """SELECT concat('w-', CAST(o AS STRING), '-', CAST(n AS STRING)) AS id, concat('job-', CAST(o AS STRING)) AS job_id, concat('tok-', CAST(o % 7 AS STRING)) AS lease_token, concat('name-', CAST(n AS STRING)) AS stored_name, CASE WHEN (o + n) % 9 = 0 THEN 'committed' ELSE 'planned' END AS state, o, n FROM outputs"""),
    "output_objects": (("orders",), lambda d: f"""SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'originals' ELSE 'processed' END AS area, name AS stored_name, concat(CASE WHEN o_orderkey % 10 = 0 THEN 'originals/' ELSE 'processed/' END, name) AS location, CAST(100 + o_orderkey % 7 AS BIGINT) AS size,
            CASE WHEN o_orderkey % 12 <> 5 THEN {d.minutes("o_orderkey * 2 % 4320")} END AS modified_at
        FROM (SELECT *, concat(CASE WHEN o_orderkey % 3 = 0 THEN upper({_uuid("o_orderkey")}) ELSE {_uuid("o_orderkey")} END, CASE o_orderkey % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.zip' WHEN 2 THEN '-page-0001.png' WHEN 3 THEN '-page-1.jpg' ELSE '.txt' END) AS name FROM orders)"""),
    "service_policies": (("nation",), lambda d: """SELECT concat('src', CAST(n_nationkey AS STRING)) AS service_name, CAST(n_nationkey % 3 AS INT) AS rate_limit_per_minute, CAST(n_nationkey % 5 AS INT) AS daily_job_limit, CAST(n_nationkey % 4 AS INT) AS max_storage_mb,
            CASE WHEN n_nationkey % 2 = 0 THEN concat('https://hooks.example.org/', CAST(n_nationkey AS STRING)) END AS webhook_url FROM nation WHERE n_nationkey < 15"""),
    "deliveries": (("jobs",), lambda d: f"""SELECT concat('d-', id) AS id, id AS job_id, requested_by AS service_name, 'https://hooks.example.org/x' AS url, concat('job.', status) AS event,
            CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'retrying' WHEN 2 THEN 'delivered' ELSE 'dead' END AS status, CAST(o_orderkey % 6 AS INT) AS attempt_count, 6 AS max_attempts,
            {d.minutes("o_orderkey * 3 % 5760 + o_orderkey % 600")} AS next_attempt_at, {d.minutes("o_orderkey * 3 % 5760")} AS created_at
        FROM jobs WHERE status IN ('completed', 'failed', 'cancelled') AND o_orderkey % 5 <> 0"""),
    "archives": (("documents",), lambda d: f"""SELECT concat('a-', CAST(doc_id AS STRING)) AS id, CAST(doc_id AS STRING) AS file_id, 'archive' AS integration_name, CASE WHEN doc_id % 3 = 0 THEN concat('x', CAST(doc_id AS STRING)) END AS external_id,
            CASE WHEN doc_id % 3 = 0 THEN 'stored' ELSE 'failed' END AS status, CASE WHEN doc_id % 3 <> 0 THEN 'timeout' END AS error, {d.minutes("doc_id * 5")} AS created_at FROM documents WHERE doc_id % 2 = 0"""),
    "journal": (("jobs",), lambda d: """SELECT concat('j-', id) AS id, id AS job_id, lease_epoch, concat('tok-', CAST(o_orderkey AS STRING)) AS lease_token, concat('obj-', CAST(o_orderkey % 400 AS STRING)) AS stored_name, 'result' AS role,
            CASE WHEN o_orderkey % 4 = 0 THEN 'committed' ELSE 'planned' END AS state FROM jobs WHERE o_orderkey % 2 = 0"""),
    "http_requests": (("events",), lambda d: "SELECT CAST(ts AS TIMESTAMP) AS ts, 'GET' AS method, event_type AS route, CAST(CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 17 = 0 THEN 404 ELSE 200 END AS INT) AS status, value / 1000 AS duration_s, event_id, concat('src', CAST(user_id % 20 AS STRING)) AS service_name FROM events"),
    "job_events": (("events",), lambda d: f"SELECT CAST(ts AS TIMESTAMP) AS ts, CAST(event_id % 3000 AS STRING) AS job_id, CASE event_id % 3 WHEN 0 THEN 'interactive' WHEN 1 THEN 'pdf' ELSE 'heavy' END AS queue_class, {_operation('event_id')} AS operation, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS state, CASE WHEN event_id % 7 <> 0 THEN (value - 20) / 10 END AS duration_s, event_id FROM events"),
    "audit_events": (("events",), lambda d: "SELECT CAST(ts AS TIMESTAMP) AS ts, CASE event_id % 4 WHEN 0 THEN 'job.queued' WHEN 1 THEN 'job.started' WHEN 2 THEN 'job.completed' ELSE 'job.failed' END AS event, concat('src', CAST(user_id % 20 AS STRING)) AS actor, 'job' AS resource_type, CAST(user_id % 997 AS STRING) AS resource_id, event_id FROM events"),
    "lease_events": (("events",), lambda d: f"""SELECT ts, {d.millis("ts")} AS ms, seq, job_id, kind, token, epoch FROM (SELECT {d.squeezed("ts", 200)} AS ts, event_id AS seq, CAST(user_id AS STRING) AS job_id,
            CASE WHEN event_id % 4 = 0 THEN 'claim' WHEN event_id % 40 = 7 THEN 'cancel' WHEN event_id % 8 = 3 THEN 'finish' ELSE 'renew' END AS kind, concat('t', CAST(CAST(floor(event_id / 4) AS BIGINT) % 2 AS STRING)) AS token, CAST(CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END AS INT) AS epoch FROM events)"""),
    "delivery_outcomes": (("events",), lambda d: f"""SELECT ts, {d.millis("ts")} AS ms, seq, delivery_id, kind, max_attempts FROM (SELECT CAST(ts AS TIMESTAMP) AS ts, event_id AS seq, user_id AS delivery_id,
            CASE WHEN event_id % 13 = 0 AND user_id % 3 <> 0 THEN 'requeue' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'ok' ELSE 'fail' END AS kind, CAST(4 AS INT) AS max_attempts FROM events)"""),
    "lifecycle_events": (("events",), lambda d: f"""SELECT ts, {d.millis("ts")} AS ms, seq, job_id, CASE WHEN job % 3 = 0 THEN 'interactive' WHEN job % 3 = 1 THEN 'pdf' ELSE 'heavy' END AS queue_class, event FROM (
            SELECT CAST(ts AS TIMESTAMP) AS ts, event_id AS seq, CAST(CAST(floor(event_id / 4) AS BIGINT) AS STRING) AS job_id, CAST(floor(event_id / 4) AS BIGINT) AS job,
            CASE WHEN event_id % 4 = 0 THEN 'job.queued' WHEN event_id % 4 = 1 THEN 'job.started' WHEN event_id % 4 = 2 AND event_type <> 'click' THEN 'job.progress' WHEN event_type = 'error' THEN 'job.failed' WHEN event_type = 'view' THEN 'job.cancelled' ELSE 'job.completed' END AS event FROM events)"""),
    "metric_samples": (("events",), lambda d: "SELECT 'jobs_failed_total' AS metric, CASE event_id % 3 WHEN 0 THEN 'interactive' WHEN 1 THEN 'pdf' ELSE 'heavy' END AS queue_class, CAST(ts AS TIMESTAMP) AS ts, CAST(event_id % 50 AS DOUBLE) AS value, event_id FROM events"),
    "doc_pages": (("documents",), lambda d: d.pages),
    "questions": (("conversations", "n_docs"), lambda d: f"""SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING), '-', CAST(i AS STRING)) AS question_id, CAST(conv_id % n AS STRING) AS doc_id, question, lag(question) OVER (PARTITION BY conv_id ORDER BY turn, i) AS previous_question
        FROM ({d.sentences}) CROSS JOIN n_docs WHERE trim(question) <> ''"""),
    "spans": (("orders",), lambda d: f"""SELECT CAST(o_orderkey AS STRING) AS page_id, CAST(cell AS INT) AS seq, CAST(20 + (cell % 3) * 50 + (o_orderkey % 7) * (cell % 2) + CASE WHEN o_orderkey % 17 = 0 AND cell = 5 THEN 200 ELSE 0 END AS DOUBLE) AS x,
            CAST(697 - floor(cell / 3) * 20 - CASE WHEN o_orderkey % 19 = 0 AND cell = 4 THEN 20 ELSE 0 END AS DOUBLE) AS y, CASE WHEN o_orderkey % 23 = 0 AND cell = 7 THEN ' =sum' ELSE concat('v', CAST(o_orderkey AS STRING), '-', CAST(cell AS STRING)) END AS text
        FROM orders CROSS JOIN ({_CELLS}) WHERE o_orderkey % 3 <> 1 OR (o_orderkey + cell) % 5 <> 0"""),
    "rules": (("orders",), lambda d: """SELECT CAST(o_orderkey AS STRING) AS page_id, axis, CASE WHEN axis = 'x' THEN 10.0 + k * 50 ELSE 555.0 + k * 20 END + CASE WHEN o_orderkey % 31 = 0 AND k = 2 THEN 45.0 ELSE 0.0 END AS pos,
            CASE WHEN axis = 'x' THEN 555.0 ELSE 10.0 END AS lo, CASE WHEN axis = 'x' THEN 715.0 ELSE 160.0 END + CASE WHEN o_orderkey % 37 = 0 AND k = 1 THEN 9.0 ELSE 0.0 END AS hi
        FROM orders CROSS JOIN (SELECT 'x' AS axis, 0 AS k UNION ALL SELECT 'x', 1 UNION ALL SELECT 'x', 2 UNION ALL SELECT 'x', 3 UNION ALL SELECT 'y', 0 UNION ALL SELECT 'y', 1 UNION ALL SELECT 'y', 2 UNION ALL SELECT 'y', 3
            UNION ALL SELECT 'y', 4 UNION ALL SELECT 'y', 5 UNION ALL SELECT 'y', 6 UNION ALL SELECT 'y', 7 UNION ALL SELECT 'y', 8)"""),
    "archive_members": (("lineitem",), lambda d: """SELECT CAST(l_orderkey AS STRING) AS archive_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS seq,
            concat(CASE WHEN l_partkey % 53 = 0 THEN '../' WHEN l_partkey % 59 = 0 THEN '/' ELSE 'dir/' END, CASE WHEN l_suppkey % 2 = 0 THEN 'Page' ELSE 'page' END, CAST(l_partkey % 200 AS STRING), CASE WHEN l_partkey % 61 = 0 THEN '.BIN' ELSE '.png' END) AS name,
            CAST(floor(l_extendedprice) AS BIGINT) AS file_size, CAST(floor(l_extendedprice / (1 + l_partkey % 90)) AS BIGINT) AS compress_size, CAST(CASE WHEN l_partkey % 71 = 0 THEN 12 ELSE 8 END AS INT) AS compress_type, 33188 AS mode, CAST(CASE WHEN l_partkey % 67 = 0 THEN 1 ELSE 0 END AS INT) AS flag_bits, l_partkey % 83 = 0 AS is_dir FROM lineitem"""),
    "page_plans": (("documents",), lambda d: """SELECT CAST(doc_id AS STRING) AS plan_id, CAST(doc_id AS STRING) AS doc_id, CASE doc_id % 10 WHEN 0 THEN '1' WHEN 1 THEN '1,2' WHEN 2 THEN '2-1' WHEN 3 THEN 'z-1' WHEN 4 THEN '1-z' WHEN 5 THEN '1,,2' WHEN 6 THEN '1-2,2' WHEN 7 THEN '0' WHEN 8 THEN '999' ELSE 'z' END AS expression FROM documents"""),
}


def fixture(spark: SparkSession, sf_dir: str, name: str, seen: dict[str, DataFrame] | None = None) -> DataFrame:
    """A domain table as a DataFrame."""
    seen = {} if seen is None else seen
    if name not in seen:
        if name in FIXTURES:
            needs, sql = FIXTURES[name]
            text = sql(SparkSQL)
            frames = {n: fixture(spark, sf_dir, n, seen) for n in needs}
            for n in needs:
                text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 «{n}»", text)
            text = text.replace("{", "{{").replace("}", "}}").replace("«", "{").replace("»", "}")
            seen[name] = spark.sql(text, **frames)
        else:
            seen[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return seen[name]


def ctes(*names: str) -> str:
    """WITH a AS (...), b AS (...) for DuckDB, dependencies first; to be followed by more CTEs after a comma, or SELECT."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in FIXTURES and n not in order:
            for m in FIXTURES[n][0]:
                visit(m)
            order.append(n)

    for n in names:
        visit(n)
    return "" if not order else "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n][1](DuckSQL)})" for n in order)
