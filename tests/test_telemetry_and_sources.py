from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quirework.operators import telemetry as t
from quirework.sources import readers
from quirework.streaming import jobs as s

NOW = datetime(2024, 1, 4)


def test_job_metrics(spark):
    rows = [(NOW, "1", "heavy", "ocr", "failed", None), (NOW, "2", "interactive", "rotate", "completed", 1.25), (NOW, "3", "interactive", "rotate", "completed", -3.0)]
    df = spark.createDataFrame(rows, "ts timestamp, job_id string, queue_class string, operation string, state string, duration_s double")
    got = {(r.queue_class, r.operation, r.state): (r.events, r.duration_sum, r.samples) for r in t.job_metrics(df).collect()}
    assert got["heavy", "ocr", "failed"] == (1, 0.0, 0) and got["interactive", "rotate", "completed"] == (2, 1.25, 2) and got[None, None, None] == (3, 1.25, 2)


def test_queue_snapshot(spark):
    jobs = spark.createDataFrame([("rotate", "queued", NOW - timedelta(seconds=45)), ("split", "queued", NOW)] + [("ocr", "queued", NOW - timedelta(minutes=12))] * 7, "operation string, status string, created_at timestamp")
    workers = spark.createDataFrame([("interactive",), ("interactive",), ("pdf",), ("heavy",)], "queue_class string")
    assert {r.queue_class: (r.depth, r.oldest_s, r.workers) for r in t.queue_snapshot(jobs, workers, NOW).collect()} == {"interactive": (2, 45.0, 2), "pdf": (0, 0.0, 1), "heavy": (7, 720.0, 1)}


def test_counter_resets(spark):
    df = spark.createDataFrame([("m", NOW + timedelta(seconds=i), i, float(v)) for i, v in enumerate((5, 7, 2, 4))], "metric string, ts timestamp, seq int, value double")
    assert t.counter_increase(df).first().increase == 6.0


def test_sustained(spark):
    df = spark.createDataFrame([(i * 15, i != 4) for i in range(20)], "at long, condition boolean").withColumn("name", F.lit("n"))
    assert [(r.since, r.firing_from, r.until) for r in t.sustained(df, 120, "name").collect()] == [(75, 195, 285)]


def test_rate_limit(spark):
    requests = spark.createDataFrame([("s", NOW + timedelta(seconds=k), k) for k in (1, 2, 61)], "service_name string, ts timestamp, event_id long")
    policies = spark.createDataFrame([("s", 1, 0, 0, None)], "service_name string, rate_limit_per_minute int, daily_job_limit int, max_storage_mb int, webhook_url string")
    assert [r.refused for r in t.rate_limit(requests, policies).orderBy("event_id").collect()] == [False, True, False]


def fold(spark, rows, start, step, schema, **more):
    return s.fold(spark.createDataFrame(rows, "k string, at long, seq long, kind string, token string, epoch int, max_attempts int"), "k", start, step, schema, **more).collect()


def test_delivery_states(spark):
    rows = [("d", i, 0, kind, None, None, 2) for i, kind in enumerate(("fail", "fail", "ok", "requeue"))]
    got = fold(spark, rows, {"status": "queued", "attempts": 0, "next_at": 0}, s.delivery_step, "k string, at long, status string, attempts int, next_at long", every=True)
    assert [(r.status, r.attempts) for r in got] == [("retrying", 1), ("dead", 2), ("dead", 2), ("queued", 0)]


def test_lease_states(spark):
    rows = [("j", at, i, kind, token, epoch, None) for i, (at, kind, token, epoch) in enumerate([(0, "claim", "a", 0), (1, "claim", "b", 0), (100, "renew", "a", 1), (101, "renew", "b", 1), (102, "renew", "a", 2), (300, "renew", "a", 1), (301, "finish", "a", 1)])]
    got = fold(spark, rows, {"status": "queued", "token": "", "epoch": 0, "expires": 0}, s.lease_step, "k string, at long, status string, token string, epoch int, expires long", every=True)
    assert [(r.status, r.token, r.epoch, r.expires) for r in got] == [("running", "a", 1, 180)] * 2 + [("running", "a", 1, 280)] * 5


def test_storage_admission(spark):
    mb = 1024 * 1024
    uploads = spark.createDataFrame([("1", "s", NOW, mb // 2), ("2", "s", NOW + timedelta(seconds=1), mb), ("3", "s", NOW + timedelta(seconds=2), mb // 2), ("4", "t", NOW, 9 * mb)], "id string, service_name string, ts timestamp, size long")
    policies = spark.createDataFrame([("s", 1), ("t", 0)], "service_name string, max_storage_mb int")
    assert {r.id: r.accepted for r in s.admit_storage(uploads, policies).collect()} == {"1": True, "2": False, "3": True, "4": True}


def test_audit_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(NOW + timedelta(seconds=i), "job.é", f"a{i}", None, None, {"k": "v"} if i else None) for i in range(3)], readers.AUDIT).coalesce(1)
    readers.write_audit(df, path)
    readers.write_audit(df.limit(1).withColumn("actor", F.lit("later")), path)
    (tmp_path / "log" / "batch-9").mkdir()
    (tmp_path / "log" / "batch-9" / "more.json").write_text('\n  \n{"broken\n{"event"\n')
    actors = lambda n: [r.actor for r in readers.read_audit(spark, path, limit=n).collect()]
    # two broken lines stand last and use up the limit
    assert actors(2) == [] and actors(3) == ["later"] and actors(5) == ["later", "a2", "a1"]
    got = readers.read_audit(spark, path, limit=10).collect()
    assert [r.actor for r in got] == ["later", "a2", "a1", "a0"] and got[3].details == {} and got[0].event == "job.é"


def test_only_the_newest_audit_files_are_read(spark, tmp_path):
    (tmp_path / "log").mkdir()
    for i in range(60):
        (tmp_path / "log" / f"batch-{i:03d}.json").write_text("".join(f'{{"event": "e{i}.{k}"}}\n\n' for k in range(3)))
    read = readers.read_audit(spark, str(tmp_path / "log"), 10)
    assert [r.event for r in read.collect()] == [f"e{59 - k // 3}.{2 - k % 3}" for k in range(10)]
    assert len(read.inputFiles()) == 4
    assert readers.read_audit(spark, str(tmp_path / "log"), 1000).count() == 180


def test_storage_and_landing(spark, tmp_path):
    for p, b in (("originals/a.pdf", b"%PDF-1"), ("processed/b.png", b"x"), ("previews/c", b"x"), ("originals/deep/d", b"x")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    got = {(r.area, r.stored_name, r.size) for r in readers.list_storage(spark, str(tmp_path)).collect()}
    assert got == {("originals", "a.pdf", 6), ("processed", "b.png", 1)}
    rows = s.run_once(s.ingest_stream(spark, str(tmp_path / "originals" / "*.pdf"), "o"), str(tmp_path / "run")).collect()
    assert [(r.original_name, r.size, r.source_system, r.content_type, r.reason) for r in rows] == [("a.pdf", 6, "o", "application/pdf", None)]


@pytest.mark.parametrize(("name", "head", "kind"), [("a.pdf", b"%PDF-1.7", "application/pdf"), ("a.pdf", b"PK", None), ("a.PNG", b"\x89PNG\r\n\x1a\n1", "image/png"), ("a.webp", b"RIFF1234WEBP", "image/webp"), ("a.webp", b"RIFF1234WAVE", None), ("a.txt", "é\n".encode(), "text/plain"), ("a.txt", b"\xff\xfe", None), ("a.txt", b"\x01", None), ("a.gif", b"GIF89a", "image/gif"), ("pdf", b"%PDF-", None)])
def test_media_types(spark, name, head, kind):
    df = spark.createDataFrame([(name, bytearray(head))], "path string, content binary")
    assert readers.sniff_type(df).first().content_type == kind


def test_page_csv(spark, tmp_path):
    cells = spark.createDataFrame([("p", 0, 0, "Name"), ("p", 0, 1, 'Q"ty'), ("p", 1, 0, "a,b")], "page_id string, row int, col int, text string")
    readers.write_page_csv(cells, str(tmp_path / "csv"))
    out = [f.read_bytes() for f in (tmp_path / "csv").rglob("*.txt")]
    assert out == ['\ufeffName,"Q""ty"\r\n"a,b",\r\n'.encode()]


def test_maintenance_batches_are_written_once(spark, tmp_path):
    run = s.maintenance_batch(lambda df: df.where("id % 2 = 0"), str(tmp_path / "plan"))
    for _ in range(2):
        run(spark.range(10), 0)
    assert spark.read.parquet(str(tmp_path / "plan")).count() == 5


def test_streams_say_what_batches_say(spark, sf_dir):
    from quirework.plans import registry

    q = registry.queries()
    for name in ("str8_lease_states", "str9_storage_admission", "str6_alert_states"):
        batch, stream = q[name](spark, sf_dir), q[f"{name}_stream"](spark, sf_dir)
        assert sorted(batch.columns) == sorted(stream.columns)
        assert sorted(map(tuple, batch.select(*sorted(batch.columns)).collect())) == sorted(map(tuple, stream.select(*sorted(batch.columns)).collect())), name


def test_alert_states_over_midnight(spark):
    rows = [("a", 86400 + 15 * k, not -8 <= k < -6, 60) for k in range(-12, 12)]
    evals = spark.createDataFrame(rows, "name string, at long, condition boolean, for_s int")
    state, want = {"phase": "inactive", "since": 0}, []
    for r in sorted(evals.collect(), key=lambda r: r["at"]):
        state = s.alert_step(state, r)
        want.append((r["at"], state["phase"], state["since"]))
    got = sorted((r["at"], r.phase, r.since) for r in t.alert_states(evals, "name").collect())
    assert got == want and any(p == "firing" and a > 86400 > b for a, p, b in got)
