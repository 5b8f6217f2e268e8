"""Queries over the catalog tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import catalog as c
from quirework.plans.fixtures import NOW, ctes, fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
T = f"TIMESTAMP '{NOW}'"
ACTIVE_IDS = "active AS (SELECT DISTINCT x AS file_id FROM (SELECT unnest(from_json(input_file_ids_json, '[\"VARCHAR\"]')) AS x FROM jobs WHERE status IN ('queued', 'running')))"


def query(name: str, needs: str, sql: str | None = None):
    """Registers f(tables...) under name; sql follows the tables' common table expressions."""

    def keep(f):
        tables = needs.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            seen: dict[str, DataFrame] = {}
            return f(*(fixture(spark, sf_dir, t, seen) for t in tables))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = ctes(*tables) + sql if sql.startswith(",") else f"{ctes(*tables)} {sql}"
        return f

    return keep


def text(*names: str):
    return [F.col(n).cast("string").alias(n) for n in names]


@query("flt1_active_files", "files", f"SELECT id, size FROM files WHERE expires_at IS NULL OR expires_at > {T}")
def _(files):
    return c.active_files(files, NOW).select("id", "size")


@query("flt2_visible_files", "files", "SELECT id, source_system FROM files WHERE source_system = 'src3'")
def _(files):
    return c.visible_to(files, "src3").select("id", "source_system")


@query("flt3_name_search", "files", "SELECT id, original_name FROM files WHERE contains(lower(original_name), 'report 1')")
def _(files):
    return c.name_contains(files, "  REPORT 1 ").select("id", "original_name")


@query("flt4_file_kinds", "files", "SELECT id, CASE WHEN content_type = 'application/pdf' THEN 'pdf' WHEN content_type LIKE 'image/%' THEN 'image' ELSE 'other' END AS kind FROM files")
def _(files):
    return c.with_kind(files).select("id", "kind")


@query("flt5_job_view", "jobs", """SELECT id, operation, status, len(from_json(input_file_ids_json, '["VARCHAR"]')) AS n_inputs, CASE WHEN json_valid(params_json) THEN params_json ->> 'pages' END AS pages FROM jobs WHERE requested_by = 'src4'""")
def _(jobs):
    return c.job_view(jobs, mine="src4").select("id", "operation", "status", F.size("input_file_ids").cast("long").alias("n_inputs"), F.col("params")["pages"].alias("pages"))


@query("flt6_job_triage", "jobs", "SELECT id, operation, status, CAST(progress AS INTEGER) AS progress, CAST(created_at AS VARCHAR) AS created_at, CAST(started_at AS VARCHAR) AS started_at, CAST(finished_at AS VARCHAR) AS finished_at, error IS NOT NULL AS failure_recorded FROM jobs WHERE status = 'failed'")
def _(jobs):
    out = c.job_triage(jobs, status="failed")
    return out.select("id", "operation", "status", F.col("progress").cast("int").alias("progress"), *text("created_at", "started_at", "finished_at"), "failure_recorded")


@query("flt7_deliveries", "deliveries", "SELECT id, event, CAST(created_at AS VARCHAR) AS created_at FROM deliveries WHERE status = 'dead' ORDER BY deliveries.created_at DESC, id DESC LIMIT 100")
def _(deliveries):
    return c.deliveries(deliveries, status="dead").select("id", "event", *text("created_at"))


@query("flt8_routes", "jobs", """SELECT id, operation, q AS queue_class, CASE q WHEN 'interactive' THEN 600 WHEN 'pdf' THEN 1800 WHEN 'heavy' THEN 3600 END AS time_limit_s, CASE operation WHEN 'pdf-to-images' THEN '.zip' ELSE '.pdf' END AS suffix
    FROM (SELECT *, CASE WHEN operation IN ('organize', 'split', 'rotate', 'watermark', 'page-numbers', 'stamp') THEN 'interactive' WHEN operation IN ('merge', 'compress', 'images-to-pdf') THEN 'pdf' ELSE 'heavy' END AS q FROM jobs)""")
def _(jobs):
    return c.route_operations(jobs).select("id", "operation", "queue_class", "time_limit_s", "suffix")


@query("flt9_param_violations", "jobs", r""", p AS (SELECT id, operation AS op, json_valid(params_json) AS ok, CASE WHEN json_valid(params_json) THEN params_json ELSE '{}' END AS j FROM jobs),
    bounds(op, k, lo, hi, whole) AS (VALUES ('images-to-pdf', 'margin', 0, 240, false), ('images-to-pdf', 'dpi', 72, 600, true), ('pdf-to-images', 'dpi', 72, 600, true), ('pdf-to-images', 'first_page', 1, 100000, true), ('pdf-to-images', 'last_page', 1, 100000, true),
        ('watermark', 'font_size', 8, 160, false), ('watermark', 'opacity', 0.02, 1, false), ('watermark', 'rotation', -180, 180, false), ('watermark', 'margin', 0, 240, false), ('page-numbers', 'start_number', 0, 1000000, true), ('page-numbers', 'font_size', 6, 36, false), ('page-numbers', 'margin', 0, 240, false),
        ('stamp', 'scale', 0.03, 0.8, false), ('stamp', 'margin', 0, 240, false)),
    allowed(op, k, pattern) AS (SELECT op, 'position', '(center|(top|bottom)-(left|center|right))' FROM (VALUES ('watermark'), ('page-numbers'), ('stamp')) t(op) UNION ALL VALUES ('images-to-pdf', 'page_size', 'auto|a4|letter'), ('images-to-pdf', 'fit', 'contain|cover'), ('pdf-to-images', 'format', 'png|jpeg'),
        ('rotate', 'degrees', '-90|90|180|270'), ('ocr', 'languages', '[a-z0-9+_-]+'), ('ocr', 'deskew', 'true|false'), ('ocr', 'rotate_pages', 'true|false'), ('page-numbers', 'format', '(?s).{1,120}'), ('watermark', 'text', '(?s).{1,240}')),
    m AS (SELECT id, 'params: not JSON' AS v FROM p WHERE NOT ok
        UNION ALL SELECT id, 'pages: required' FROM p WHERE ok AND op = 'split' AND json_extract_string(j, '$.pages') IS NULL
        UNION ALL SELECT id, 'text: required' FROM p WHERE ok AND op = 'watermark' AND json_extract_string(j, '$.text') IS NULL
        UNION ALL SELECT id, 'pages: malformed' FROM p WHERE op IN ('split', 'rotate') AND NOT (length(json_extract_string(j, '$.pages')) <= 256 AND regexp_full_match(json_extract_string(j, '$.pages'), '(?:[1-9][0-9]*|z)(?:-(?:[1-9][0-9]*|z))?(?:,(?:[1-9][0-9]*|z)(?:-(?:[1-9][0-9]*|z))?)*'))
        UNION ALL SELECT id, k || ': out of range' FROM (SELECT id, k, lo, hi, whole, json_extract_string(j, '$.' || k) AS x FROM p JOIN bounds USING (op)) WHERE x IS NOT NULL AND NOT coalesce(try_cast(x AS DOUBLE) BETWEEN lo AND hi AND (NOT whole OR try_cast(x AS DOUBLE) = floor(try_cast(x AS DOUBLE))), false)
        UNION ALL SELECT id, k || ': not allowed' FROM (SELECT id, k, pattern, json_extract_string(j, '$.' || k) AS x FROM p JOIN allowed USING (op)) WHERE NOT regexp_full_match(x, pattern))
    SELECT p.id, coalesce(string_agg(v, '; ' ORDER BY v), '') AS violations FROM p LEFT JOIN m ON m.id = p.id GROUP BY p.id""")
def _(jobs):
    return c.validate_params(jobs).select("id", F.array_join("violations", "; ").alias("violations"))


@query("join1_reconcile", "files storage_objects", r""",
    r AS (SELECT id AS file_id, stored_name AS recorded, size, stored_name LIKE 's3:%' AS wrong, regexp_extract(stored_name, '([^/]*)$', 1) AS base FROM files),
    o AS (SELECT stored_name AS listed, count(*) AS copies, list(location) AS places, any_value(size) AS object_size FROM storage_objects GROUP BY stored_name),
    b AS (SELECT * FROM (SELECT * FROM r WHERE NOT wrong) g FULL OUTER JOIN o ON g.recorded = o.listed)
    SELECT 'backend_mismatch' AS category, recorded AS stored_name, file_id, NULL AS location FROM r WHERE wrong
    UNION ALL SELECT 'invalid_stored_name', recorded, file_id, NULL FROM r WHERE NOT wrong AND base <> recorded
    UNION ALL SELECT 'missing_object', recorded, file_id, NULL FROM b WHERE listed IS NULL
    UNION ALL SELECT 'duplicate_storage_name', recorded, file_id, NULL FROM b WHERE file_id IS NOT NULL AND copies > 1
    UNION ALL SELECT 'size_mismatch', recorded, file_id, NULL FROM b WHERE file_id IS NOT NULL AND copies = 1 AND object_size <> size
    UNION ALL SELECT 'orphan_object', listed, NULL, unnest(places) FROM b WHERE file_id IS NULL""")
def _(files, objects):
    return c.reconcile(files, objects)


@query("join2_purge_plan", "files jobs", f", {ACTIVE_IDS} SELECT id, size FROM files WHERE expires_at <= {T} AND NOT EXISTS (SELECT 1 FROM active a WHERE a.file_id = files.id)")
def _(files, jobs):
    return c.purge_candidates(files, jobs, NOW).select("id", "size")


@query("join3_files_in_use", "files jobs", f", {ACTIVE_IDS} SELECT id FROM files WHERE EXISTS (SELECT 1 FROM active a WHERE a.file_id = files.id)")
def _(files, jobs):
    return c.in_use(files, jobs).select("id")


@query("join4_orphan_outputs", "output_objects files jobs", rf""",
    n AS (SELECT *, lower(regexp_extract(stored_name, '(?i)^([0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})(?:\.(?:pdf|zip)|-page-[0-9]{{4}}\.(?:png|jpg))$', 1)) AS job_id, (epoch({T}) - epoch(modified_at)) / 3600 AS age FROM output_objects WHERE area = 'processed')
    SELECT job_id, n.stored_name, location, size, CAST(floor(age) AS BIGINT) AS age_hours, j.status AS job_status FROM n JOIN jobs j ON j.id = job_id
    WHERE age >= 24 AND j.status IN ('failed', 'cancelled') AND NOT EXISTS (SELECT 1 FROM files f WHERE f.stored_name = n.stored_name)""".replace(f"{T}", T))
def _(objects, files, jobs):
    return c.orphan_outputs(objects, files, jobs, NOW).select("job_id", "stored_name", "location", "size", "age_hours", "job_status")


@query("join5_input_checks", "jobs files", f""",
    i AS (SELECT id, operation, requested_by, unnest(from_json(input_file_ids_json, '["VARCHAR"]')) AS file_id FROM jobs),
    k AS (SELECT i.id, CASE WHEN f.id IS NULL THEN 1 WHEN f.expires_at <= {T} THEN 2 WHEN f.source_system <> i.requested_by THEN 3
        WHEN NOT (CASE i.operation WHEN 'images-to-pdf' THEN regexp_full_match(content_type, 'image/(jpeg|png|webp|tiff|bmp)') WHEN 'office-to-pdf' THEN regexp_full_match(content_type, 'application/(msword|rtf|vnd[.](ms-excel|ms-powerpoint|oasis[.]opendocument[.](text|spreadsheet|presentation)|openxmlformats-officedocument[.](wordprocessingml[.]document|spreadsheetml[.]sheet|presentationml[.]presentation)))') ELSE content_type = 'application/pdf' END) THEN 4 END AS rank FROM i LEFT JOIN files f ON f.id = i.file_id)
    SELECT j.id, j.operation, CASE min(rank) WHEN 1 THEN 404 WHEN 2 THEN 410 WHEN 3 THEN 403 WHEN 4 THEN 415 ELSE 0 END AS failed_rule FROM jobs j LEFT JOIN k ON k.id = j.id GROUP BY j.id, j.operation""")
def _(jobs, files):
    return c.check_inputs(jobs, files, NOW).withColumn("failed_rule", F.coalesce("failed_rule", F.lit(0)))


@query("join6_manifests", "jobs artifacts files", """,
    l AS (SELECT job_id, file_id, role, ordinal FROM artifacts UNION ALL
          SELECT id, output_file_id, CASE WHEN operation IN ('pdf-to-images', 'split-to-zip', 'extract-pages-zip', 'extract-images') THEN 'bundle' ELSE 'result' END, NULL FROM jobs
          WHERE status = 'completed' AND output_file_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.job_id = jobs.id)),
    g AS (SELECT j.id, count(l.file_id) AS n, count(*) FILTER (f.source_system IS NULL OR f.source_system <> requested_by) AS away, count(*) FILTER (l.file_id = output_file_id) AS prim,
            count(*) FILTER (role IN ('result', 'bundle')) AS roots, count(*) FILTER (role IN ('result', 'bundle') AND l.file_id = output_file_id) AS prim_roots, count(*) FILTER (role = 'result') AS results,
            count(*) FILTER (role = 'bundle' AND content_type <> 'application/zip') AS unzipped, coalesce(list_sort(list(coalesce(ordinal, 0)) FILTER (role = 'part')), []) AS ords
          FROM jobs j LEFT JOIN l ON l.job_id = j.id LEFT JOIN files f ON f.id = l.file_id GROUP BY j.id)
    SELECT j.id AS job_id, n AS artifacts, CASE WHEN status <> 'completed' THEN '409' WHEN output_file_id IS NULL THEN '410' WHEN n > 201 THEN '409' WHEN away > 0 OR prim = 0 THEN '410'
        WHEN roots <> 1 OR prim_roots <> 1 OR (results > 0 AND n > 1) OR unzipped > 0 OR ords <> range(1, len(ords) + 1) THEN '409' ELSE 'ok' END AS manifest FROM jobs j JOIN g ON g.id = j.id""")
def _(jobs, artifacts, files):
    return c.artifact_manifest(jobs, artifacts, files)


#: What the manifest must be, rule by rule: links or, without any, the primary file; the first rule that is broken gives the code.
MANIFESTS = """,
    li AS (SELECT job_id, file_id, role, ordinal FROM made_artifacts),
    it AS (SELECT * FROM li UNION ALL SELECT id, output_file_id, CASE WHEN operation IN ('pdf-to-images', 'split-to-zip', 'extract-pages-zip', 'extract-images') THEN 'bundle' ELSE 'result' END, NULL FROM made_jobs
           WHERE status = 'completed' AND output_file_id IS NOT NULL AND id NOT IN (SELECT job_id FROM li)),
    x AS (SELECT j.id AS job_id, j.status, j.output_file_id, j.requested_by, i.file_id, i.role, i.ordinal, f.id AS found, f.source_system, f.content_type, f.original_name, f.size, f.sha256, f.expires_at
          FROM made_jobs j LEFT JOIN it i ON i.job_id = j.id LEFT JOIN made_files f ON f.id = i.file_id),
    p AS (SELECT job_id, count(*) FILTER (role = 'part') AS n, list_sort(list(ordinal) FILTER (role = 'part')) AS have FROM x GROUP BY job_id),
    v AS (SELECT job_id, count(file_id) AS artifacts, CASE
            WHEN any_value(status) <> 'completed' THEN '409'
            WHEN any_value(output_file_id) IS NULL THEN '410'
            WHEN count(file_id) > 201 THEN '409'
            WHEN bool_or(found IS NULL OR source_system <> requested_by) THEN '410'
            WHEN NOT bool_or(file_id = output_file_id) THEN '410'
            WHEN count(*) FILTER (role = 'result' OR role = 'bundle') <> 1 THEN '409'
            WHEN bool_or(role IN ('result', 'bundle') AND file_id <> output_file_id) THEN '409'
            WHEN bool_or(role NOT IN ('result', 'part', 'bundle')) THEN '409'
            WHEN bool_or(role <> 'part' AND ordinal IS NOT NULL) THEN '409'
            WHEN any_value(p.n) > 0 AND any_value(have) <> range(1, any_value(p.n) + 1) THEN '409'
            WHEN bool_or(role = 'result') AND count(file_id) <> 1 THEN '409'
            WHEN bool_or(role = 'bundle' AND content_type <> 'application/zip') THEN '409'
            ELSE 'ok' END AS manifest FROM x JOIN p USING (job_id) GROUP BY job_id)"""


@query("join6_checked_manifests", "made_jobs made_artifacts made_files", MANIFESTS + " SELECT job_id, artifacts, manifest FROM v")
def _(jobs, artifacts, files):
    return c.artifact_manifest(jobs, artifacts, files)


@query("join6_manifest_rows", "made_jobs made_artifacts made_files", MANIFESTS + """ SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN file_id = output_file_id THEN 0 ELSE 1 END, coalesce(ordinal, 0)) AS INTEGER) AS position, file_id, role, CAST(ordinal AS INTEGER) AS ordinal, original_name AS file_name, content_type, size, sha256, source_system, CAST(epoch(expires_at) AS BIGINT) AS expires_at
    FROM x WHERE job_id IN (SELECT job_id FROM v WHERE manifest = 'ok')""")
def _(jobs, artifacts, files):
    return c.manifest_rows(jobs, artifacts, files).withColumn("expires_at", F.unix_timestamp("expires_at"))


@query("join17_job_journal", "write_journal", """, f AS (SELECT job_id, lease_token, stored_name FROM write_journal WHERE o % 2 = 0 AND n % 3 <> 0),
    r AS (SELECT job_id, lease_token, stored_name, n % 4 <> 0 AS ok FROM write_journal WHERE n % 5 <> 0 UNION ALL SELECT job_id, lease_token, stored_name, o % 11 <> 0 FROM write_journal WHERE n % 2 = 0),
    b AS (SELECT job_id, lease_token, stored_name FROM r GROUP BY ALL HAVING bool_and(ok))
    SELECT id, job_id, stored_name, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.job_id = w.job_id AND f.lease_token = w.lease_token AND f.stored_name = w.stored_name) THEN 'committed'
        WHEN EXISTS (SELECT 1 FROM b WHERE b.job_id = w.job_id AND b.lease_token = w.lease_token AND b.stored_name = w.stored_name) THEN 'compensated' ELSE 'needs_review' END AS state FROM write_journal w WHERE state = 'planned'""")
def _(journal):
    """Names repeat over jobs; some clean-ups have several results."""
    results = journal.where("n % 5 <> 0").withColumn("succeeded", F.col("n") % 4 != 0).union(journal.where("n % 2 = 0").withColumn("succeeded", F.col("o") % 11 != 0))
    return c.settle_journal(journal, journal.where("o % 2 = 0 AND n % 3 <> 0"), results)


POLICY = """, eff AS (SELECT s.service_name, CAST(coalesce(rate_limit_per_minute, 120) AS INTEGER) AS rate_limit_per_minute, CAST(coalesce(daily_job_limit, 1000) AS INTEGER) AS daily_job_limit, CAST(coalesce(max_storage_mb, 2048) AS INTEGER) AS max_storage_mb, webhook_url
    FROM (SELECT DISTINCT source_system AS service_name FROM files) s LEFT JOIN service_policies p ON p.service_name = s.service_name)"""


@query("join7_policies", "files service_policies", POLICY + " SELECT * FROM eff")
def _(files, policies):
    return c.effective_policy(files.select(F.col("source_system").alias("service_name")), policies)


@query("join8_new_webhooks", "jobs service_policies deliveries", """SELECT id AS job_id, 'job.' || status AS event, requested_by AS service_name, webhook_url AS url FROM jobs JOIN service_policies ON service_name = requested_by
    WHERE webhook_url IS NOT NULL AND status IN ('completed', 'failed', 'cancelled') AND NOT EXISTS (SELECT 1 FROM deliveries d WHERE d.job_id = jobs.id AND d.event = 'job.' || jobs.status)""")
def _(jobs, policies, known):
    return c.enqueue_webhooks(jobs, policies, known, NOW).select("job_id", "event", "service_name", "url")


@query("join9_dead_deliveries", "deliveries jobs", "SELECT id, job_id FROM deliveries WHERE status IN ('queued', 'retrying') AND job_id NOT IN (SELECT id FROM jobs WHERE o_orderkey % 3 <> 0)")
def _(deliveries, jobs):
    return c.dead_missing_jobs(deliveries, jobs.where("o_orderkey % 3 <> 0")).select("id", "job_id")


@query("join10_allowed_hosts", "pages", """SELECT page_id, host, coalesce(host = 'site1.example.com' OR ends_with(host, '.example.com') OR ends_with(host, '.example.org'), false) AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:]+)', 1)) AS host FROM pages)""")
def _(pages):
    urls = pages.select("page_id", F.lower(F.regexp_extract("url", "^https?://([^/:]+)", 1)).alias("host"))
    rules = pages.sparkSession.createDataFrame([("Site1.example.com.",), ("*.example.com",), ("*.example.org",), ("*",)], "rule string")
    return c.host_allowed(urls, rules)


@query("join11_owner_archives", "archives files", "SELECT a.id, a.file_id FROM (SELECT * FROM archives ORDER BY created_at DESC, id DESC LIMIT 100) a WHERE file_id IN (SELECT id FROM files WHERE source_system = 'src4')")
def _(archives, files):
    return c.owner_archives(archives, files, "src4").select("id", "file_id")


@query("join12_archive_upserts", "jobs files archives", """,
    n AS (SELECT DISTINCT output_file_id AS file_id, 'archive' AS integration_name FROM jobs WHERE status = 'completed' AND output_file_id IN (SELECT id FROM files WHERE content_type = 'application/pdf'))
    SELECT file_id, integration_name, external_id, CASE WHEN n.file_id IS NOT NULL THEN 'submitting' ELSE status END AS status, CASE WHEN n.file_id IS NULL THEN error END AS error, a.id IS NULL AS inserted FROM archives a FULL OUTER JOIN n USING (file_id, integration_name)""")
def _(jobs, files, archives):
    return c.archive_upserts(jobs, files, archives)


@query("join13_delete_plan", "files artifacts jobs archives", f""", {ACTIVE_IDS}, chosen AS (SELECT id AS file_id, size FROM files WHERE size % 7 = 0), free AS (SELECT * FROM chosen WHERE file_id NOT IN (SELECT file_id FROM active))
    SELECT 'blocked' AS action, file_id, NULL AS target, 0 AS bytes FROM chosen WHERE file_id IN (SELECT file_id FROM active) UNION ALL SELECT 'delete_file', file_id, file_id, size FROM free
    UNION ALL SELECT 'drop_artifact', file_id, job_id, 0 FROM artifacts WHERE file_id IN (SELECT file_id FROM free) UNION ALL SELECT 'clear_output', output_file_id, id, 0 FROM jobs WHERE output_file_id IN (SELECT file_id FROM free)
    UNION ALL SELECT 'drop_archive', file_id, id, 0 FROM archives WHERE file_id IN (SELECT file_id FROM free)""")
def _(files, artifacts, jobs, archives):
    return c.file_delete_plan(files.where("size % 7 = 0").select(F.col("id").alias("file_id")), files, artifacts, jobs, archives)


@query("join14_history_plan", "jobs deliveries artifacts", """, mine AS (SELECT id FROM jobs WHERE requested_by = 'src5' AND status IN ('completed', 'failed', 'cancelled'))
    SELECT 'drop_delivery' AS action, job_id, id AS target FROM deliveries WHERE job_id IN (SELECT id FROM mine) UNION ALL SELECT 'drop_artifact', job_id, file_id FROM artifacts WHERE job_id IN (SELECT id FROM mine) UNION ALL SELECT 'drop_job', id, id FROM mine""")
def _(jobs, deliveries, artifacts):
    return c.history_clear_plan(jobs, deliveries, artifacts, "src5")


@query("join15_retryable", "jobs files", """SELECT id, operation FROM jobs WHERE status IN ('failed', 'cancelled') AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(from_json(jobs.input_file_ids_json, '["VARCHAR"]')) AS x) WHERE x NOT IN (SELECT id FROM files WHERE size % 50 <> 1))""")
def _(jobs, files):
    return c.retryable(jobs, files.where("size % 50 <> 1")).select("id", "operation")


@query("join16_stalled_leases", "jobs journal", f"""SELECT j.id, rq_job_id, lease_epoch, lease_token, 'failed' AS queue_status FROM jobs j WHERE status = 'running' AND lease_token IS NOT NULL AND output_file_id IS NULL AND epoch({T}) - epoch(lease_expires_at) >= 300 AND o_orderkey % 4 <> 1
    AND NOT EXISTS (SELECT 1 FROM journal k WHERE k.job_id = j.id AND k.lease_epoch = j.lease_epoch AND k.state = 'committed')""")
def _(jobs, journal):
    queue = jobs.select("rq_job_id", F.when(F.col("o_orderkey") % 4 == 1, "started").otherwise("failed").alias("status"))
    return c.stalled_leases(jobs, queue, journal, NOW)


@query("join17_settled_journal", "journal files", """SELECT id, job_id, stored_name, CASE WHEN stored_name IN (SELECT stored_name FROM files) THEN 'committed' WHEN length(stored_name) = 6 THEN 'compensated' ELSE 'needs_review' END AS state FROM journal WHERE state = 'planned'""")
def _(journal, files):
    kept = journal.join(files.select("stored_name").distinct(), "stored_name", "left_semi")
    cleanup = journal.where("length(stored_name) <> 5").withColumn("succeeded", F.length("stored_name") == 6)
    return c.settle_journal(journal, kept, cleanup)


@query("agg1_job_counts", "jobs", "SELECT s AS status, count(j.id) AS n FROM (SELECT unnest(['queued', 'running', 'completed', 'failed', 'cancelled']) AS s) LEFT JOIN jobs j ON j.status = s GROUP BY s")
def _(jobs):
    return c.job_status_counts(jobs)


@query("agg2_library_totals", "files", "SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM files")
def _(files):
    return c.library_totals(files)


@query("agg3_storage_usage", "files service_policies", POLICY + f""", u AS (SELECT source_system AS service_name, CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE expires_at IS NULL OR expires_at > {T} GROUP BY 1)
    SELECT service_name, bytes, max_storage_mb, max_storage_mb > 0 AND bytes + 1000000 > CAST(max_storage_mb AS BIGINT) * 1048576 AS over FROM u JOIN eff USING (service_name)""")
def _(files, policies):
    return c.storage_usage(files, policies, NOW, incoming=1_000_000)


@query("agg4_daily_jobs", "jobs service_policies", f"""SELECT u.service_name, n, CAST(coalesce(daily_job_limit, 1000) AS INTEGER) AS daily_job_limit, coalesce(daily_job_limit, 1000) > 0 AND n >= coalesce(daily_job_limit, 1000) AS exhausted
    FROM (SELECT requested_by AS service_name, count(*) AS n FROM jobs WHERE created_at >= date_trunc('day', {T}) GROUP BY 1) u LEFT JOIN service_policies p ON p.service_name = u.service_name""")
def _(jobs, policies):
    return c.daily_job_usage(jobs, policies, NOW)


@query("agg5_reconcile_summary", "files storage_objects")
def _(files, objects):
    return c.reconcile_summary(c.reconcile(files, objects), files, objects)


ORACLES["agg5_reconcile_summary"] = f"""WITH issues AS ({ORACLES["join1_reconcile"]}), {ctes("files", "storage_objects")[5:]}
    SELECT count(*) FILTER (category = 'backend_mismatch') AS backend_mismatch, count(*) FILTER (category = 'duplicate_storage_name') AS duplicate_storage_name, count(*) FILTER (category = 'invalid_stored_name') AS invalid_stored_name,
        count(*) FILTER (category = 'missing_object') AS missing_object, count(*) FILTER (category = 'orphan_object') AS orphan_object, count(*) FILTER (category = 'size_mismatch') AS size_mismatch,
        (SELECT count(*) FROM files) AS records, (SELECT count(*) FROM storage_objects) AS objects, count(*) = 0 AS healthy, count(*) > 200 AS truncated FROM issues"""


@query("agg11_cleanup_report", "files jobs", f""", {ACTIVE_IDS}, e AS (SELECT id, size FROM files WHERE expires_at <= {T}), p AS (SELECT * FROM e WHERE id NOT IN (SELECT file_id FROM active))
    SELECT (SELECT count(*) FROM e) AS scanned, count(*) AS purged, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM p""")
def _(files, jobs):
    return c.cleanup_report(files, c.purge_candidates(files, jobs, NOW), NOW)


@query("win11_daily_admission", "jobs service_policies", """SELECT id, requested_by, CAST(rank AS INTEGER) AS rank, coalesce(daily_job_limit, 1000) <= 0 OR rank <= coalesce(daily_job_limit, 1000) AS admitted
    FROM (SELECT *, row_number() OVER (PARTITION BY requested_by, CAST(created_at AS DATE) ORDER BY created_at, id) AS rank FROM jobs) LEFT JOIN service_policies ON service_name = requested_by""")
def _(jobs, policies):
    return c.admit_daily(jobs, policies).select("id", "requested_by", "rank", "admitted")


@query("top1_library_page", "files", f"SELECT id, original_name, size FROM files WHERE (expires_at IS NULL OR expires_at > {T}) AND contains(lower(original_name), 'report') ORDER BY expires_at ASC NULLS LAST, id ASC LIMIT 40 OFFSET 10")
def _(files):
    return c.library_page(files, NOW, sort="expires_at", order="asc", limit=40, offset=10, q="report").select("id", "original_name", "size")


@query("top1_next_pages", "files", f""", l AS (SELECT id, expires_at FROM files WHERE expires_at IS NULL OR expires_at > {T})
    SELECT 'asc' AS way, id FROM (SELECT id FROM l ORDER BY expires_at ASC NULLS LAST, id ASC LIMIT 40 OFFSET (SELECT greatest(count(*) - 29, 0) FROM l)) UNION ALL SELECT 'desc', id FROM (SELECT id FROM l ORDER BY expires_at DESC NULLS FIRST, id DESC LIMIT 40 OFFSET 11)""")
def _(files):
    """The pages that follow a row by its key: ascending among files that never expire, descending over from them."""
    total = c.library(files, NOW).count()
    out = []
    for way, place in (("asc", max(total - 30, 0)), ("desc", 10)):
        last = c.library_page(files, NOW, sort="expires_at", order=way, limit=1, offset=place).first()
        page = c.library_page(files, NOW, sort="expires_at", order=way, limit=40, after=(last["expires_at"], last["id"]))
        out.append(page.select(F.lit(way).alias("way"), "id"))
    return out[0].union(out[1])


@query("top1_library_count", "files", f"SELECT count(*) AS total, count(*) > 50 AS has_more FROM files WHERE (expires_at IS NULL OR expires_at > {T}) AND content_type LIKE 'image/%'")
def _(files):
    return c.library_count(files, NOW, limit=40, offset=10, file_kind="image")


@query("top2_job_page", "jobs", "SELECT id, CAST(created_at AS VARCHAR) AS created_at FROM jobs ORDER BY jobs.created_at DESC, id DESC LIMIT 51 OFFSET 20")
def _(jobs):
    return c.job_page(jobs, limit=50, offset=20).select("id", *text("created_at"))


@query("top3_due_deliveries", "deliveries", f"SELECT id, CAST(next_attempt_at AS VARCHAR) AS next_attempt_at FROM (SELECT * FROM deliveries WHERE status IN ('queued', 'retrying') ORDER BY next_attempt_at, created_at, id LIMIT 50) q WHERE q.next_attempt_at <= {T}")
def _(deliveries):
    return c.due_deliveries(deliveries, NOW).select("id", *text("next_attempt_at"))


@query("top4_issue_page", "files storage_objects")
def _(files, objects):
    return c.issue_page(c.reconcile(files, objects), 60)


ORACLES["top4_issue_page"] = f"SELECT * FROM ({ORACLES['join1_reconcile']}) ORDER BY category, stored_name, coalesce(file_id, ''), coalesce(location, '') LIMIT 60"


@query("set7_scope_audit", "customer", """,
    k AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 3 WHEN 0 THEN ['files:read', 'jobs:read'] WHEN 1 THEN ['jobs:write', 'odd:scope'] ELSE [] END AS own, CASE c_custkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'viewer' END AS role FROM customer),
    e AS (SELECT id, list_distinct(list_concat(list_concat(own, CASE WHEN role = 'viewer' THEN ['files:read'] ELSE [] END), CASE WHEN role = 'admin' THEN ['*'] ELSE [] END)) AS s FROM k)
    SELECT id, array_to_string(list_sort(s), ',') AS scopes, array_to_string(list_sort(list_filter(s, lambda x: x NOT IN ('files:read', 'jobs:read', 'jobs:write', '*'))), ',') AS invalid FROM e""")
def _(customer):
    scopes = F.when(F.col("c_custkey") % 3 == 0, '["files:read","jobs:read"]').when(F.col("c_custkey") % 3 == 1, '["jobs:write","odd:scope"]').otherwise("{broken")
    keys = customer.select(F.col("c_custkey").cast("string").alias("id"), scopes.alias("scopes_json"), F.when(F.col("c_custkey") % 4 == 0, "admin").when(F.col("c_custkey") % 4 == 1, "viewer").alias("role"))
    out = c.scope_audit(keys, {"viewer": ["files:read"]}, ["files:read", "jobs:read", "jobs:write"])
    return out.select("id", F.array_join("scopes", ",").alias("scopes"), F.array_join("invalid", ",").alias("invalid"))


ORACLES["set7_scope_audit"] = "WITH " + ORACLES["set7_scope_audit"].removeprefix(ctes("customer") + ",").strip()
