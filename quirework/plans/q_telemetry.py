"""Queries over event tables, batch and streaming, and the same in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import telemetry as t
from quirework.plans.fixtures import NOW, ctes, fixture
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


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quirework-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with the time type that watermarks need."""
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern: a file or a folder
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("agg6_job_metrics", "job_events", """SELECT coalesce(queue_class, 'ALL') AS queue_class, coalesce(operation, 'ALL') AS operation, coalesce(state, 'ALL') AS state, count(*) AS events, round(coalesce(sum(greatest(duration_s, 0)), 0), 4) AS duration_sum, count(duration_s) AS samples, round(coalesce(sum(greatest(duration_s, 0)), 0) / greatest(count(duration_s), 1), 6) AS average FROM job_events GROUP BY ROLLUP (job_events.queue_class, job_events.operation, job_events.state)""")
def _(job_events):
    out = t.job_metrics(job_events)
    return out.select(*[F.coalesce(c, F.lit("ALL")).alias(c) for c in ("queue_class", "operation", "state")], "events", F.round("duration_sum", 4).alias("duration_sum"), "samples", F.round("average", 6).alias("average"))


@query("agg7_queue_snapshot", "jobs service_policies", f""", q AS (SELECT CASE WHEN operation IN ('organize', 'split', 'rotate', 'watermark', 'page-numbers', 'stamp') THEN 'interactive' WHEN operation IN ('merge', 'compress', 'images-to-pdf') THEN 'pdf' ELSE 'heavy' END AS queue_class, created_at FROM jobs WHERE status = 'queued'),
    w AS (SELECT CASE WHEN max_storage_mb = 0 THEN 'heavy' ELSE 'pdf' END AS queue_class, count(*) AS workers FROM service_policies GROUP BY 1)
    SELECT c.queue_class, count(q.created_at) AS depth, coalesce(greatest(0, epoch(TIMESTAMP '{NOW}') - epoch(min(created_at))), 0)::DOUBLE AS oldest_s, coalesce(any_value(workers), 0) AS workers FROM (SELECT unnest(['interactive', 'pdf', 'heavy']) AS queue_class) c LEFT JOIN q ON q.queue_class = c.queue_class LEFT JOIN w ON w.queue_class = c.queue_class GROUP BY c.queue_class""")
def _(jobs, policies):
    workers = policies.select(F.when(F.col("max_storage_mb") == 0, "heavy").otherwise("pdf").alias("queue_class"))
    return t.queue_snapshot(jobs, workers, NOW)


@query("agg8_latency_report", "http_requests", """SELECT route, count(*) AS n, count(*) FILTER (status < 200 OR status >= 400) AS errors, round(avg(duration_s), 9) AS mean_s, round(quantile_cont(duration_s, 0.5), 9) AS p50_s, round(quantile_cont(duration_s, 0.95), 9) AS p95_s, round(quantile_cont(duration_s, 0.99), 9) AS p99_s,
    round(count(*) FILTER (status < 200 OR status >= 400) / count(*), 9) AS error_rate, count(*) FILTER (status < 200 OR status >= 400) / count(*) <= 0.01 AND quantile_cont(duration_s, 0.95) <= 1.5 AS passed FROM http_requests GROUP BY route""")
def _(requests):
    r = t.latency_report(requests, "route").drop("per_s")
    return r.select("route", "n", "errors", *[F.round(c, 9).alias(c) for c in ("mean_s", "p50_s", "p95_s", "p99_s", "error_rate")], "passed")


@query("agg8_failures_by_status", "http_requests", "SELECT status, count(*) AS n FROM http_requests WHERE status < 200 OR status >= 400 GROUP BY status")
def _(requests):
    return t.failures_by_status(requests)


CLASS = "CASE " + " ".join(f"WHEN duration_s <= {b} THEN {b}::DOUBLE" for b in t.BOUNDS) + " ELSE 'Infinity'::DOUBLE END"


@query("agg9_histogram_quantile", "http_requests", f""", o AS (SELECT route, {CLASS} AS le, count(*) AS own FROM http_requests WHERE duration_s IS NOT NULL GROUP BY ALL),
    g AS (SELECT route, le FROM (SELECT DISTINCT route FROM o) CROSS JOIN (SELECT unnest([{", ".join(map(str, t.BOUNDS))}, 'Infinity'::DOUBLE]) AS le)),
    h AS (SELECT route, le, sum(coalesce(own, 0)) OVER (PARTITION BY route ORDER BY le) AS cnt FROM g LEFT JOIN o USING (route, le)),
    w AS (SELECT *, coalesce(lag(cnt) OVER v, 0) AS below, coalesce(lag(le) OVER v, 0) AS lower, max(cnt) OVER (PARTITION BY route) * 0.95::DOUBLE AS rank FROM h WINDOW v AS (PARTITION BY route ORDER BY le))
    SELECT route, round(CASE WHEN le = 'Infinity'::DOUBLE THEN lower ELSE lower + (le - lower) * (rank - below) / greatest(cnt - below, 1) END, 9) AS value FROM w WHERE cnt >= rank AND below < rank""")
def _(requests):
    return t.histogram_quantile(t.histogram(requests, "route"), 0.95, "route").select("route", F.round("value", 9).alias("value"))


@query("agg14_error_ratio", "http_requests", """SELECT window_start, requests, errors, round((errors / 300) / greatest(requests / 300, 0.001), 9) AS ratio, (errors / 300) / greatest(requests / 300, 0.001) > 0.05 AS alert FROM (SELECT CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS window_start, count(*) AS requests, count(*) FILTER (status >= 500) AS errors FROM http_requests GROUP BY 1)""")
def _(requests):
    return t.error_ratio(requests).withColumn("ratio", F.round("ratio", 9))


HEALTH = """, st AS (SELECT CAST(floor(epoch(ts) / 15) * 15 AS BIGINT) AS step, count(*) AS requests, count(*) FILTER (status >= 500) AS errors FROM http_requests GROUP BY 1),
    sl AS (SELECT requests, errors, unnest(generate_series(step + 15, step + 300, 15)) AS window_end FROM st)
    SELECT window_end, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(errors) AS BIGINT) AS errors, round((sum(errors) / 300) / greatest(sum(requests) / 300, 0.001), 9) AS ratio FROM sl GROUP BY window_end"""


@query("str2_http_health", "http_requests", HEALTH)
def _(requests):
    return t.http_health(requests).withColumn("ratio", F.round("ratio", 9))


@query("str3_failure_alerts", "job_events", """, st AS (SELECT queue_class, CAST(floor(epoch(ts) / 15) * 15 AS BIGINT) AS step, count(*) AS failures FROM job_events WHERE state = 'failed' GROUP BY ALL),
    e AS (SELECT * FROM st UNION ALL SELECT 'all', step, sum(failures) FROM st GROUP BY step), sl AS (SELECT queue_class, failures, unnest(generate_series(step + 15, step + 900, 15)) AS window_end FROM e)
    SELECT queue_class, window_end, CAST(sum(failures) AS BIGINT) AS failures, sum(failures) > CASE queue_class WHEN 'all' THEN 5 ELSE 3 END AS alert FROM sl GROUP BY queue_class, window_end""")
def _(job_events):
    return t.failure_alerts(job_events)


@query("win8_counter_increase", "metric_samples", """, g AS (SELECT *, lag(value) OVER (PARTITION BY metric, queue_class ORDER BY ts, event_id) AS before FROM metric_samples)
    SELECT metric, queue_class, CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) AS window_start, sum(CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END) AS increase FROM g GROUP BY ALL""")
def _(samples):
    return t.counter_increase(samples.withColumnRenamed("event_id", "seq"), 900, "queue_class")


INCREASES = """, g AS (SELECT *, lag(value) OVER (PARTITION BY metric, queue_class ORDER BY ts, event_id) AS before FROM metric_samples),
    st AS (SELECT queue_class, CAST(floor(epoch(ts) / 15) * 15 AS BIGINT) AS step, sum(CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END) AS inc FROM g GROUP BY ALL),
    e AS (SELECT queue_class, step, inc FROM st WHERE inc > 0 UNION ALL SELECT 'all', step, sum(inc) FROM st GROUP BY step HAVING sum(inc) > 0), sl AS (SELECT queue_class, inc, unnest(generate_series(step + 15, step + 900, 15)) AS window_end FROM e),
    a AS (SELECT queue_class, window_end, sum(inc) AS increase, sum(inc) > CASE queue_class WHEN 'all' THEN 5 ELSE 3 END AS alert FROM sl GROUP BY queue_class, window_end)"""


@query("win8_increase_alerts", "metric_samples", INCREASES + " SELECT queue_class, window_end, increase, alert FROM a")
def _(samples):
    return t.increase_alerts(samples.withColumnRenamed("event_id", "seq"))


@query("win8_sustained_increases", "metric_samples", INCREASES + """, i AS (SELECT queue_class, window_end AS moment, window_end - row_number() OVER (PARTITION BY queue_class ORDER BY window_end) * 15 AS island FROM a WHERE alert)
    SELECT queue_class, min(moment) AS since, min(moment) + 300 AS firing_from, max(moment) AS until FROM i GROUP BY queue_class, island HAVING max(moment) - min(moment) >= 300""")
def _(samples):
    return t.sustained_increases(samples.withColumnRenamed("event_id", "seq"))


@query("win10_route_alerts", "http_requests", """, st AS (SELECT route, CAST(floor(epoch(ts) / 15) * 15 AS BIGINT) AS step, count(*) FILTER (status >= 400) AS bad FROM http_requests GROUP BY ALL),
    sl AS (SELECT route, bad, unnest(generate_series(step + 15, step + 300, 15)) AS moment FROM st), e AS (SELECT route, moment FROM sl GROUP BY ALL HAVING sum(bad) > 0),
    i AS (SELECT route, moment, moment - row_number() OVER (PARTITION BY route ORDER BY moment) * 15 AS island FROM e) SELECT route, min(moment) AS since, min(moment) + 120 AS firing_from, max(moment) AS until FROM i GROUP BY route, island HAVING max(moment) - min(moment) >= 120""")
def _(requests):
    steps = requests.groupBy("route", t.step().alias("step")).agg(F.count_if(F.col("status") >= 400).alias("bad"))
    evals = t.sliding(steps, 300, "route", sums=("bad",)).select("route", F.col("window_end").alias("at"), (F.col("bad") > 0).alias("condition"))
    return t.sustained(evals, 120, "route")


@query("win10_sustained_alerts", "http_requests", """, st AS (SELECT CAST(floor(epoch(ts) / 15) * 15 AS BIGINT) AS step, count(*) FILTER (status >= 500) AS errors FROM http_requests GROUP BY 1),
    sl AS (SELECT errors, unnest(generate_series(step + 15, step + 300, 15)) AS moment FROM st), e AS (SELECT moment FROM sl GROUP BY moment HAVING sum(errors) > 0),
    i AS (SELECT moment, moment - row_number() OVER (ORDER BY moment) * 15 AS island FROM e) SELECT 'http' AS name, min(moment) AS since, min(moment) + 120 AS firing_from, max(moment) AS until FROM i GROUP BY island HAVING max(moment) - min(moment) >= 120""")
def _(requests):
    evals = t.http_health(requests).select(F.lit("http").alias("name"), F.col("window_end").alias("at"), (F.col("errors") > 0).alias("condition"))
    return t.sustained(evals, 120, "name")


RATE = """, r AS (SELECT event_id, service_name, ts, row_number() OVER (PARTITION BY service_name, date_trunc('minute', ts) ORDER BY ts, event_id) AS number FROM http_requests)"""


@query("str1_rate_limit", "http_requests service_policies", RATE + """ SELECT event_id, r.service_name, CAST(number AS INTEGER) AS number, coalesce(rate_limit_per_minute, 120) > 0 AND number > coalesce(rate_limit_per_minute, 120) AS refused FROM r LEFT JOIN service_policies p ON p.service_name = r.service_name""")
def _(requests, policies):
    return t.rate_limit(requests, policies).select("event_id", "service_name", "number", "refused")


@query("str4_job_lifecycle", "audit_events", f""", j AS (SELECT resource_id, min(CAST(floor(epoch(ts)) AS BIGINT)) FILTER (event = 'job.queued') AS q, min(CAST(floor(epoch(ts)) AS BIGINT)) FILTER (event = 'job.started') AS st, min((CAST(floor(epoch(ts)) AS BIGINT), event)) FILTER (event IN ('job.completed', 'job.failed')) AS e FROM audit_events GROUP BY resource_id)
    SELECT resource_id, coalesce(st - q, -999999999) AS wait_s, coalesce(e[1] - st, -999999999) AS run_s, CASE WHEN e IS NOT NULL THEN substr(e[2], 5) WHEN epoch(TIMESTAMP '2024-02-01') - st > 3600 THEN 'timed out' WHEN st IS NOT NULL THEN 'running' ELSE 'queued' END AS state FROM j""")
def _(audit):
    none = F.lit(-999999999)
    return t.job_lifecycle(audit, "2024-02-01 00:00:00").withColumns({"wait_s": F.coalesce("wait_s", none), "run_s": F.coalesce("run_s", none)})


@query("str2_http_latency", "http_requests", f""", st AS (SELECT CAST(floor(epoch(ts) / 15) * 15 AS BIGINT) AS step, {CLASS} AS le, count(*) AS n FROM http_requests WHERE duration_s IS NOT NULL GROUP BY ALL),
    sl AS (SELECT le, n, unnest(generate_series(step + 15, step + 300, 15)) AS window_end FROM st), o AS (SELECT window_end, le, sum(n) AS own FROM sl GROUP BY ALL),
    g AS (SELECT window_end, le FROM (SELECT DISTINCT window_end FROM o) CROSS JOIN (SELECT unnest([{", ".join(map(str, t.BOUNDS))}, 'Infinity'::DOUBLE]) AS le)),
    h AS (SELECT window_end, le, sum(coalesce(own, 0)) OVER (PARTITION BY window_end ORDER BY le) AS cnt FROM g LEFT JOIN o USING (window_end, le)),
    w AS (SELECT *, coalesce(lag(cnt) OVER v, 0) AS below, coalesce(lag(le) OVER v, 0) AS lower, max(cnt) OVER (PARTITION BY window_end) * 0.95::DOUBLE AS rank FROM h WINDOW v AS (PARTITION BY window_end ORDER BY le))
    SELECT window_end, round(value, 9) AS value, value > 2 AS alert FROM (SELECT window_end, CASE WHEN le = 'Infinity'::DOUBLE THEN lower ELSE lower + (le - lower) * (rank - below) / greatest(cnt - below, 1) END AS value FROM w WHERE cnt >= rank AND below < rank)""")
def _(requests):
    return t.http_latency(requests).withColumn("value", F.round("value", 9))


ALERTS = HEALTH.replace("SELECT window_end, CAST(sum(requests)", ", h AS (SELECT window_end, CAST(sum(requests)", 1) + """), e AS (SELECT window_end AS moment, errors > 0 AS hot FROM h),
    r AS (SELECT *, sum(CASE WHEN hot THEN 0 ELSE 1 END) OVER (ORDER BY moment) AS run FROM e), b AS (SELECT run, min(moment) AS since FROM r WHERE hot GROUP BY run),
    f AS (SELECT moment, hot, CASE WHEN hot THEN since END AS since, hot AND moment - since >= 120 AS fires FROM r LEFT JOIN b USING (run))
    SELECT 'http' AS name, moment AS at, CASE WHEN fires THEN 'firing' WHEN hot THEN 'pending' WHEN lag(fires) OVER (ORDER BY moment) THEN 'resolved' ELSE 'inactive' END AS phase, coalesce(since, 0) AS since FROM f"""


def _evaluations(health: DataFrame) -> DataFrame:
    return health.select(F.lit("http").alias("name"), F.col("window_end").alias("at"), F.lit(0).alias("seq"), (F.col("errors") > 0).alias("condition"), F.lit(120).alias("for_s"))


@query("str6_alert_states", "http_requests", ALERTS)
def _(requests):
    return t.alert_states(_evaluations(t.http_health(requests)), "name")


@query("str7_delivery_states", "events", """, o AS (SELECT user_id AS delivery_id, CAST(floor(epoch(ts)) AS BIGINT) AS moment, event_id AS seq, event_type = 'purchase' AS ok FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY moment, seq) AS k, count(*) OVER (PARTITION BY delivery_id) AS total, min(CASE WHEN ok THEN 1 END) OVER (PARTITION BY delivery_id ORDER BY moment, seq ROWS UNBOUNDED PRECEDING) AS won FROM o),
    f AS (SELECT delivery_id, min(k) FILTER (ok) AS first_ok, max(k) AS total FROM n GROUP BY delivery_id),
    z AS (SELECT delivery_id, CASE WHEN coalesce(first_ok, 99) <= 6 THEN 'delivered' WHEN total >= 6 THEN 'dead' ELSE 'retrying' END AS status, least(coalesce(first_ok, total), total, 6) AS attempts FROM f)
    SELECT z.delivery_id, status, CAST(attempts AS INTEGER) AS attempts, n.moment + CASE WHEN status = 'retrying' THEN CAST(least(5 * pow(2, attempts - 1), 900) AS BIGINT) ELSE 0 END AS next_at FROM z JOIN n ON n.delivery_id = z.delivery_id AND n.k = z.attempts""")
def _(events):
    outcomes = events.select(F.col("user_id").alias("delivery_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "ok").otherwise("fail").alias("kind"), F.lit(6).alias("max_attempts"))
    out = s.fold(s.telling_outcomes(outcomes), "delivery_id", s.NEW_DELIVERY, s.delivery_step, "delivery_id long, at long, status string, attempts int, next_at long")
    return out.drop("at")


LEASES = """, w AS (SELECT epoch_us(max(ts)) // 1000 - 120000 AS until FROM lease_events), e AS (SELECT l.* FROM lease_events l, w WHERE ms < until),
    c AS (SELECT job_id, min((ms, seq)) FILTER (kind = 'cancel') AS cancel, min((ms, seq, token)) FILTER (kind = 'claim') AS claim FROM e GROUP BY job_id),
    h AS (SELECT job_id, cancel, CASE WHEN cancel IS NULL OR (claim[1], claim[2]) < cancel THEN claim END AS claim FROM c),
    b AS (SELECT e.*, claim, lag(ms) OVER v AS prior, sum(CASE WHEN kind = 'finish' THEN 1 ELSE 0 END) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS finished
          FROM e JOIN h USING (job_id) WHERE kind IN ('renew', 'finish') AND token = claim[3] AND epoch = 1 AND (ms, seq) > (claim[1], claim[2]) AND (cancel IS NULL OR (ms, seq) < cancel) WINDOW v AS (PARTITION BY job_id ORDER BY ms, seq)),
    g AS (SELECT *, coalesce(prior, claim[1]) AS base, sum(CASE WHEN ms - coalesce(prior, claim[1]) >= 180000 OR finished > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ms, seq) AS lost FROM b),
    k AS (SELECT * FROM g WHERE lost = 0),
    j AS (SELECT h.job_id, h.claim, h.cancel, coalesce(max(k.ms) FILTER (kind = 'renew'), any_value(h.claim[1])) + 180000 AS expires, count(*) FILTER (kind = 'finish') AS done FROM h LEFT JOIN k ON k.job_id = h.job_id GROUP BY 1, 2, 3)
    SELECT job_id, claim[1] AS at, 'running' AS status, claim[3] AS token, 1 AS epoch, claim[1] + 180000 AS expires FROM h WHERE claim IS NOT NULL
    UNION ALL SELECT job_id, ms, CASE kind WHEN 'finish' THEN 'completed' ELSE 'running' END, claim[3], 1, 180000 + CASE kind WHEN 'finish' THEN base ELSE ms END FROM k WHERE kind = 'finish' OR ms > base
    UNION ALL SELECT job_id, expires, 'expired', claim[3], 1, expires FROM j, w WHERE claim IS NOT NULL AND done = 0 AND expires < until AND (cancel IS NULL OR cancel[1] >= expires)
    UNION ALL SELECT job_id, cancel[1], 'cancelled', coalesce(claim[3], ''), CASE WHEN claim IS NULL THEN 0 ELSE 1 END, CASE WHEN claim IS NULL THEN 0 ELSE expires END FROM j WHERE cancel IS NOT NULL AND done = 0"""


def last_ms(events: DataFrame, lateness_s: int = 120) -> int:
    """How far a stream of these events has come when it has read all: its watermark."""
    return events.agg(F.unix_millis(F.max("ts")) - lateness_s * 1000).first()[0] or 0


@query("str8_lease_states", "lease_events", LEASES)
def _(events):
    return t.lease_history(events.withColumnRenamed("ms", "at"), last_ms(events))


LIFECYCLES = """, w AS (SELECT epoch_us(max(ts)) // 1000 - 120000 AS until FROM lifecycle_events),
    j AS (SELECT job_id, queue_class, min(ms) FILTER (event = 'job.queued') AS q, min(ms) FILTER (event = 'job.started') AS s, min((ms, event)) FILTER (event IN ('job.completed', 'job.failed', 'job.cancelled')) AS e FROM lifecycle_events, w WHERE ms < until GROUP BY ALL),
    k AS (SELECT *, CASE WHEN e IS NULL OR s < e[1] THEN s END AS st FROM j),
    l AS (SELECT *, st + CASE queue_class WHEN 'interactive' THEN 600000 WHEN 'pdf' THEN 1800000 ELSE 3600000 END AS lim FROM k),
    z AS (SELECT *, e IS NOT NULL AND (lim IS NULL OR e[1] < lim) AS ok FROM l)
    SELECT job_id, queue_class, st - CASE WHEN q < coalesce(st, e[1]) THEN q END AS wait_ms, CASE WHEN ok THEN e[1] ELSE lim END - st AS run_ms, CASE WHEN ok THEN substr(e[2], 5) ELSE 'timed out' END AS state FROM z, w WHERE ok OR lim < until"""


@query("str4_class_lifecycles", "lifecycle_events", LIFECYCLES)
def _(events):
    return t.lifecycles(events.withColumnRenamed("ms", "at"), last_ms(events))


OUTCOMES = """, w AS (SELECT epoch_us(max(ts)) // 1000 - 120000 AS until FROM delivery_outcomes),
    o AS (SELECT d.*, row_number() OVER (PARTITION BY delivery_id ORDER BY ms, seq) AS k FROM delivery_outcomes d, w WHERE ms < until),
    r AS (SELECT DISTINCT delivery_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS ms, 'queued' AS status, 0 AS attempts, CAST(0 AS BIGINT) AS next_at, false AS changed FROM o
      UNION ALL SELECT r.delivery_id, o.k, o.ms, CASE WHEN kind = 'requeue' THEN CASE status WHEN 'dead' THEN 'queued' ELSE status END WHEN status NOT IN ('queued', 'retrying') THEN status WHEN kind = 'ok' THEN 'delivered' WHEN attempts + 1 >= max_attempts THEN 'dead' ELSE 'retrying' END,
        CASE WHEN kind = 'requeue' THEN CASE status WHEN 'dead' THEN 0 ELSE attempts END WHEN status NOT IN ('queued', 'retrying') THEN attempts ELSE attempts + 1 END,
        CASE WHEN kind = 'requeue' THEN CASE status WHEN 'dead' THEN o.ms ELSE next_at END WHEN status NOT IN ('queued', 'retrying') THEN next_at WHEN kind = 'ok' OR attempts + 1 >= max_attempts THEN o.ms ELSE o.ms + CAST(least(5 * pow(2, attempts), 900) AS BIGINT) * 1000 END,
        CASE WHEN kind = 'requeue' THEN status = 'dead' ELSE status IN ('queued', 'retrying') END
      FROM r JOIN o ON o.delivery_id = r.delivery_id AND o.k = r.k + 1)
    SELECT delivery_id, ms AS at, status, attempts, next_at FROM r WHERE changed"""


@query("str7_delivery_history", "delivery_outcomes", OUTCOMES)
def _(outcomes):
    return s.delivery_history(outcomes.withColumnRenamed("ms", "at").where(F.col("at") < last_ms(outcomes)))


ORACLES["str7_delivery_history"] = ORACLES["str7_delivery_history"].replace("WITH", "WITH RECURSIVE", 1)
ROUTES = """, st AS (SELECT route, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS step, count(*) AS n, count(*) FILTER (status >= 400) AS bad FROM http_requests GROUP BY ALL),
    sl AS (SELECT route, n, bad, unnest(generate_series(step + 60, step + 300, 60)) AS moment FROM st), e AS (SELECT route, moment, sum(bad) > sum(n) * 0.05::DOUBLE AS hot FROM sl GROUP BY ALL HAVING moment * 1000 < (SELECT epoch_us(max(ts)) // 1000 - 120000 FROM http_requests)),
    r AS (SELECT *, sum(CASE WHEN hot THEN 0 ELSE 1 END) OVER (PARTITION BY route ORDER BY moment) AS run FROM e), b AS (SELECT route, run, min(moment) AS since FROM r WHERE hot GROUP BY ALL),
    f AS (SELECT route, moment, hot, CASE WHEN hot THEN since END AS since, hot AND moment - since >= 120 AS fires FROM r LEFT JOIN b USING (route, run))
    SELECT route, moment AS at, CASE WHEN fires THEN 'firing' WHEN hot THEN 'pending' WHEN lag(fires) OVER (PARTITION BY route ORDER BY moment) THEN 'resolved' ELSE 'inactive' END AS phase, coalesce(since, 0) AS since FROM f"""


@query("str6_route_alerts", "http_requests", ROUTES)
def _(requests):
    steps = requests.groupBy("route", t.step(seconds=60).alias("step")).agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 400).alias("bad"))
    slid = t.sliding(steps, 300, "route", sums=("n", "bad"), step_s=60).where(F.col("window_end") * 1000 < last_ms(requests))
    return t.alert_states(slid.select("route", F.col("window_end").alias("at"), (F.col("bad") > F.col("n") * 0.05).alias("condition"), F.lit(120).alias("for_s")), "route")


ADMISSION = """, u AS (SELECT f.id, f.source_system AS service_name, f.size * 40 AS size, coalesce(CAST(max_storage_mb AS BIGINT), 2048) * 1048576 AS room, row_number() OVER (PARTITION BY f.source_system ORDER BY created_at, f.id) AS k FROM files f LEFT JOIN service_policies p ON p.service_name = f.source_system),
    r AS (SELECT id, service_name, k, room <= 0 OR size <= room AS accepted, CASE WHEN size <= room THEN size ELSE 0 END AS used FROM u WHERE k = 1
      UNION ALL SELECT u.id, u.service_name, u.k, u.room <= 0 OR r.used + u.size <= u.room, r.used + CASE WHEN r.used + u.size <= u.room THEN u.size ELSE 0 END FROM r JOIN u ON u.service_name IS NOT DISTINCT FROM r.service_name AND u.k = r.k + 1)
    SELECT id, service_name, accepted FROM r"""


@query("str9_storage_admission", "files service_policies", ADMISSION)
def _(files, policies):
    uploads = files.select("id", F.col("source_system").alias("service_name"), F.col("created_at").alias("ts"), (F.col("size") * 40).alias("size"))
    return s.admit_storage(uploads, policies)


ORACLES["str9_storage_admission"] = ORACLES["str9_storage_admission"].replace("WITH", "WITH RECURSIVE", 1)


def stream(name: str, sql: str | None = None, needs: str = "http_requests"):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = ctes(*needs.split()) + sql
        return f

    return keep


def _requests(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 17 == 0, 404).otherwise(200)
    return events.select("ts", status.alias("status"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("service_name"), "event_id")


@stream("str1_rate_counts_stream", """, m AS (SELECT CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS minute, service_name, count(*) AS requests FROM http_requests GROUP BY ALL)
    SELECT minute, m.service_name, requests, CAST(CASE WHEN coalesce(rate_limit_per_minute, 120) > 0 THEN greatest(0, requests - coalesce(rate_limit_per_minute, 120)) ELSE 0 END AS BIGINT) AS refused FROM m LEFT JOIN service_policies p ON p.service_name = m.service_name
    WHERE minute + 60 <= (SELECT epoch(max(ts)) - 120 FROM http_requests)""", "http_requests service_policies")
def _(spark, sf_dir):
    counts = s.rate_counts(_requests(event_stream(spark, sf_dir)))
    return s.refused_counts(s.run_once(counts, folder(spark)), fixture(spark, sf_dir, "service_policies"))


@stream("str2_http_health_stream", HEALTH.replace("FROM sl GROUP BY window_end", "FROM sl GROUP BY window_end HAVING window_end <= (SELECT epoch(max(ts)) - 120 FROM http_requests)"))
def _(spark, sf_dir):
    return s.run_once(s.http_health_stream(_requests(event_stream(spark, sf_dir))), folder(spark)).withColumn("ratio", F.round("ratio", 9))


@stream("str5_notifications_stream", ", n AS (SELECT DISTINCT user_id AS job_id, event_type AS event FROM events) SELECT * FROM n", "http_requests")
def _(spark, sf_dir):
    notes = event_stream(spark, sf_dir).select("ts", F.col("user_id").alias("job_id"), F.col("event_type").alias("event"))
    return s.run_once(s.dedupe_notifications(notes, "60 days").select("job_id", "event"), folder(spark))


@stream("str3_failure_alerts_stream", """, st AS (SELECT queue_class, CAST(floor(epoch(ts) / 15) * 15 AS BIGINT) AS step, count(*) AS failures FROM job_events WHERE state = 'failed' GROUP BY ALL), sl AS (SELECT queue_class, failures, unnest(generate_series(step + 15, step + 900, 15)) AS window_end FROM st)
    SELECT queue_class, window_end, CAST(sum(failures) AS BIGINT) AS failures, sum(failures) > 3 AS alert FROM sl GROUP BY queue_class, window_end HAVING window_end <= (SELECT epoch(max(ts)) - 120 FROM job_events WHERE state = 'failed')""", "job_events")
def _(spark, sf_dir):
    e = event_stream(spark, sf_dir)
    k = F.col("event_id") % 3
    rows = e.select("ts", F.when(k == 0, "interactive").when(k == 1, "pdf").otherwise("heavy").alias("queue_class"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("state"))
    return s.run_once(s.failure_alerts_stream(rows, overall=None), folder(spark))


@stream("str4_lifecycle_stream")
def _(spark, sf_dir):
    e = event_stream(spark, sf_dir).select("ts", (F.col("user_id")).alias("resource_id"), F.when(F.col("event_id") % 4 == 1, "job.started").when(F.col("event_id") % 4 == 2, "job.completed").otherwise("job.failed").alias("event"), (F.col("event_id") % 4).alias("k"))
    return s.run_once(s.lifecycle_stream(e.where("k = 1"), e.where("k >= 2")), folder(spark)).select("job_id", F.unix_timestamp("started_at").alias("started"), F.unix_timestamp("ended_at").alias("ended"), "state")


@stream("str7_delivery_states_stream")
def _(spark, sf_dir):
    e = event_stream(spark, sf_dir)
    outcomes = e.select(F.col("user_id").alias("delivery_id"), F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "ok").otherwise("fail").alias("kind"), F.lit(6).alias("max_attempts"))
    folded = s.fold_stream(outcomes, "delivery_id", {"status": "queued", "attempts": 0, "next_at": 0}, s.delivery_step, "delivery_id long, at long, status string, attempts int, next_at long", "status string, attempts int, next_at long")
    return s.run_once(folded, folder(spark)).drop("at")


ORACLES["str7_delivery_states_stream"] = ORACLES["str7_delivery_states"]


@stream("str6_alert_states_stream", ALERTS)
def _(spark, sf_dir):
    """The evaluations as a stream of their own, their state kept from batch to batch; every state comes out."""
    where = folder(spark)
    _evaluations(t.http_health(fixture(spark, sf_dir, "http_requests"))).write.parquet(f"{where}/evaluations")
    evals = spark.readStream.schema("name string, at long, seq int, condition boolean, for_s int").parquet(f"{where}/evaluations")
    folded = s.fold_stream(evals, "name", {"phase": "inactive", "since": 0}, s.alert_step, "name string, at long, phase string, since long", "phase string, since long", every=True)
    return s.run_once(folded, where)


def domain_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table that is derived from the events alone, as a stream."""
    return fixture(spark, sf_dir, name, {"events": event_stream(spark, sf_dir)})


@stream("str8_lease_states_stream")
def _(spark, sf_dir):
    return s.run_once(s.lease_history_stream(domain_stream(spark, sf_dir, "lease_events").drop("ms")), folder(spark))


@stream("str4_class_lifecycles_stream")
def _(spark, sf_dir):
    return s.run_once(s.lifecycles_stream(domain_stream(spark, sf_dir, "lifecycle_events").drop("ms")), folder(spark))


@stream("str7_delivery_history_stream")
def _(spark, sf_dir):
    return s.run_once(s.delivery_history_stream(domain_stream(spark, sf_dir, "delivery_outcomes").drop("ms")), folder(spark))


@stream("str6_route_alerts_stream")
def _(spark, sf_dir):
    return s.run_once(s.alert_history_stream(s.route_evaluations_stream(domain_stream(spark, sf_dir, "http_requests")), ["route"]), folder(spark))


for of in ("str8_lease_states", "str4_class_lifecycles", "str7_delivery_history", "str6_route_alerts"):
    ORACLES[f"{of}_stream"] = ORACLES[of]


@stream("str1_rate_verdicts_stream", RATE.replace("date_trunc('minute', ts) ORDER BY ts, event_id", "date_trunc('minute', ts) ORDER BY epoch_us(ts) // 1000, event_id").replace("FROM http_requests)", "FROM http_requests WHERE epoch_us(ts) // 1000 < (SELECT epoch_us(max(ts)) // 1000 - 120000 FROM http_requests))") + """ SELECT event_id, r.service_name, CAST(number AS INTEGER) AS number, coalesce(rate_limit_per_minute, 120) > 0 AND number > coalesce(rate_limit_per_minute, 120) AS refused FROM r LEFT JOIN service_policies p ON p.service_name = r.service_name""", "http_requests service_policies")
def _(spark, sf_dir):
    return s.run_once(s.rate_verdicts_stream(domain_stream(spark, sf_dir, "http_requests"), fixture(spark, sf_dir, "service_policies")), folder(spark))


@stream("str2_http_latency_stream", ORACLES["str2_http_latency"].removeprefix(ctes("http_requests")).replace("WHERE cnt >= rank AND below < rank)", "WHERE cnt >= rank AND below < rank) WHERE window_end <= (SELECT epoch(max(ts)) - 120 FROM http_requests)"))
def _(spark, sf_dir):
    out = s.run_once(s.http_latency_stream(domain_stream(spark, sf_dir, "http_requests")), folder(spark))
    return out.withColumn("value", F.round("value", 9))


@stream("str3_all_failure_alerts_stream", ORACLES["str3_failure_alerts"].removeprefix(ctes("job_events")) + " HAVING window_end <= (SELECT epoch(max(ts)) - 120 FROM job_events WHERE state = 'failed')", "job_events")
def _(spark, sf_dir):
    return s.run_once(s.failure_alerts_stream(domain_stream(spark, sf_dir, "job_events")), folder(spark))


@stream("str9_storage_admission_stream")
def _(spark, sf_dir):
    """Uploads as a stream; what a service has used is its state."""
    where = folder(spark)
    files = fixture(spark, sf_dir, "files")
    files.select("id", F.col("source_system").alias("service_name"), F.unix_micros("created_at").alias("at"), (F.col("size") * 40).alias("size")).write.parquet(f"{where}/uploads")
    uploads = spark.readStream.schema("id string, service_name string, at long, size long").parquet(f"{where}/uploads").withColumn("seq", F.col("id"))
    folded = s.fold_stream(s.with_limits(uploads, fixture(spark, sf_dir, "service_policies")), "service_name", {"id": "", "accepted": False, "used": 0}, s.storage_step, "service_name string, at long, id string, accepted boolean, used long", "id string, accepted boolean, used long", every=True)
    return s.run_once(folded, where).select("id", "service_name", "accepted")


ORACLES["str9_storage_admission_stream"] = ORACLES["str9_storage_admission"]
