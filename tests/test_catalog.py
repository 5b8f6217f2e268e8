"""Small cases with known answers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quirework import schemas
from quirework.operators import catalog as c

NOW = datetime(2024, 1, 4)


def table(spark, name, rows):
    schema = schemas.TABLES[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


@pytest.fixture(scope="module")
def files(spark):
    day = timedelta(days=1)
    docx = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    rows = [("Alpha Report.pdf", "application/pdf", 300, "user:alpha", -5, None), ("Beta Report.pdf", "application/pdf", 100, "user:alpha", -4, 1), ("Gamma Scan.png", "image/png", 200, "user:alpha", -3, 1), ("Old Report.pdf", "application/pdf", 50, "user:alpha", -2, -1), ("Other.docx", docx, 400, "user:other", -1, None)]
    return table(spark, "files", [{"id": n.split()[0], "original_name": n, "stored_name": n.lower(), "content_type": t, "size": s, "source_system": o, "created_at": NOW + day * a, "expires_at": None if e is None else NOW + day * e} for n, t, s, o, a, e in rows])


def names(df):
    return [r.id for r in df.collect()]


def test_library(files):
    assert names(c.library_page(files, NOW, sort="name", order="asc", q="report", file_kind="pdf")) == ["Alpha", "Beta"]
    assert names(c.library_page(files, NOW, sort="name", order="asc", q="report", include_expired=True)) == ["Alpha", "Beta", "Old"]
    assert names(c.library_page(files, NOW, sort="size", order="desc", owner="user:alpha")) == ["Alpha", "Gamma", "Beta"]
    assert names(c.library_page(files, NOW, q="%")) == []
    assert names(c.library_page(files, NOW, sort="size", order="asc", after=(200, "Gamma"))) == ["Alpha", "Other.docx"]
    assert c.library_count(files, NOW, limit=2).first().asDict() == {"total": 4, "has_more": True}


def test_a_file_that_expires_now_is_expired(spark):
    df = table(spark, "files", [{"id": "x", "expires_at": NOW}, {"id": "y", "expires_at": NOW + timedelta(seconds=1)}])
    assert names(c.active_files(df, NOW)) == ["y"]


def test_visibility(files):
    assert names(c.visible_to(files, "user:other")) == ["Other.docx"]
    assert c.visible_to(files, "user:other", wildcard=True).count() == 5
    assert c.visible_to(files, "user:other", wildcard=True, institutional=True).count() == 1


def test_reconcile_local(spark):
    files = table(spark, "files", [{"id": n, "stored_name": n, "size": s} for n, s in (("ok", 2), ("missing", 7), ("mismatch", 9), ("dup", 3))])
    objects = table(spark, "storage_objects", [{"area": a, "stored_name": n, "location": f"{a}/{n}", "size": s} for a, n, s in (("originals", "ok", 2), ("processed", "mismatch", 3), ("processed", "orphan", 6), ("originals", "dup", 3), ("processed", "dup", 3))])
    issues = c.reconcile(files, objects)
    assert sorted(r.category for r in issues.collect()) == ["duplicate_storage_name", "missing_object", "orphan_object", "size_mismatch"]
    s = c.reconcile_summary(issues, files, objects, 3).first()
    assert (s.records, s.objects, s.healthy, s.truncated) == (4, 5, False, True)


def test_reconcile_s3(spark):
    files = table(spark, "files", [{"id": n, "stored_name": n, "size": s} for n, s in (("s3:a", 1), ("s3:gone", 1), ("s3:b", 9), ("local", 1))])
    objects = table(spark, "storage_objects", [{"area": "originals", "stored_name": n, "location": n, "size": s} for n, s in (("a", 1), ("b", 2), ("extra", 1))])
    assert sorted(r.category for r in c.reconcile(files, objects, "s3").collect()) == ["backend_mismatch", "missing_object", "orphan_object", "size_mismatch"]


def test_purge_spares_inputs_of_active_jobs(spark):
    files = table(spark, "files", [{"id": "a", "size": 5, "expires_at": NOW - timedelta(hours=1)}, {"id": "b", "size": 7, "expires_at": NOW - timedelta(hours=1)}, {"id": "c", "size": 9}])
    jobs = table(spark, "jobs", [{"id": "1", "status": "queued", "input_file_ids_json": '["a"]'}, {"id": "2", "status": "running", "input_file_ids_json": "{broken"}, {"id": "3", "status": "completed", "input_file_ids_json": '["b"]'}])
    plan = c.purge_candidates(files, jobs, NOW)
    assert names(plan) == ["b"] and names(c.in_use(files, jobs)) == ["a"]
    assert c.cleanup_report(files, plan, NOW).first().asDict() == {"scanned": 2, "purged": 1, "bytes": 7}


def test_orphan_outputs(spark):
    u = ["%08d-0000-4000-8000-000000000000" % i for i in range(8)]
    old, new = NOW - timedelta(hours=48), NOW - timedelta(hours=2)
    status = ["failed", "cancelled", "running", "completed", "failed", "failed", "failed", "failed"]
    jobs = table(spark, "jobs", [{"id": i, "status": s} for i, s in zip(u, status, strict=True)])
    name = [f"{u[0]}-page-0001.png", f"{u[1]}.ZIP", f"{u[2]}.pdf", f"{u[3]}.pdf", f"{u[4]}.pdf", f"{u[5]}.exe", f"{u[6]}.pdf", f"{u[7]}.pdf"]
    when = [old, old, old, old, new, old, None, old]
    objects = table(spark, "storage_objects", [{"area": "originals" if i == 7 else "processed", "stored_name": n, "location": n, "size": 1, "modified_at": w} for i, (n, w) in enumerate(zip(name, when, strict=True))])
    got = c.orphan_outputs(objects, table(spark, "files", []), jobs, NOW).collect()
    assert {r.job_id for r in got} == {u[0], u[1]} and {r.age_hours for r in got} == {48}
    assert c.orphan_outputs(objects, table(spark, "files", [{"id": "f", "stored_name": name[0]}]), jobs, NOW).count() == 1


def manifest(spark, links, owner="o", primary="p", status="completed", kind="application/zip"):
    jobs = table(spark, "jobs", [{"id": "j", "operation": "split-to-zip", "status": status, "output_file_id": primary, "requested_by": "o"}])
    files = table(spark, "files", [{"id": i, "source_system": owner if i == "b" else "o", "content_type": kind} for i in ("p", "a", "b")])
    artifacts = table(spark, "job_output_artifacts", [{"job_id": "j", "file_id": f, "role": r, "ordinal": n} for f, r, n in links])
    return c.artifact_manifest(jobs, artifacts, files).first().manifest


def test_manifests(spark):
    whole = [("p", "bundle", None), ("a", "part", 1), ("b", "part", 2)]
    assert manifest(spark, whole) == "ok" and manifest(spark, []) == "ok"
    assert manifest(spark, whole, owner="stranger") == "410"
    assert manifest(spark, whole, status="running") == "409"
    assert manifest(spark, whole, primary=None) == "410"
    assert manifest(spark, whole, kind="application/pdf") == "409"
    assert manifest(spark, [("p", "bundle", None), ("a", "part", 1), ("b", "part", 3)]) == "409"
    assert manifest(spark, [("a", "bundle", None), ("p", "part", 1)]) == "409"
    assert manifest(spark, [("p", "result", None), ("a", "part", 1)]) == "409"
    assert manifest(spark, [("gone", "bundle", None), ("p", "part", 1)]) == "410"
    assert manifest(spark, [("p", "bundle", None), ("a", "thumbnail", None)]) == "409"
    assert manifest(spark, [("p", "bundle", 1), ("a", "part", 1)]) == "409"
    assert manifest(spark, [("p", "bundle", None), ("a", "part", None)]) == "409"


def test_manifest_rows(spark):
    jobs = table(spark, "jobs", [{"id": i, "operation": "split-to-zip", "status": "completed", "output_file_id": f"p{i}", "requested_by": "o"} for i in "xyz"])
    files = table(spark, "files", [{"id": f"{k}{i}", "original_name": f"{k}.bin", "source_system": "o", "content_type": "application/zip", "size": 5, "sha256": "s"} for k in "pab" for i in "xyz"])
    artifacts = table(spark, "job_output_artifacts", [{"job_id": j, "file_id": f + j, "role": r, "ordinal": n} for j, f, r, n in [("x", "b", "part", 1), ("x", "a", "part", 2), ("x", "p", "bundle", None), ("y", "p", "bundle", None), ("y", "a", "part", 2)]])
    got = sorted((r.job_id, r.position, r.file_id, r.role, r.ordinal, r.file_name, r.size) for r in c.manifest_rows(jobs, artifacts, files).collect())
    assert got == [("x", 1, "px", "bundle", None, "p.bin", 5), ("x", 2, "bx", "part", 1, "b.bin", 5), ("x", 3, "ax", "part", 2, "a.bin", 5), ("z", 1, "pz", "bundle", None, "p.bin", 5)]


def test_policies_and_quotas(spark):
    policies = table(spark, "service_policies", [{"service_name": "service-a", "rate_limit_per_minute": 100, "daily_job_limit": 1, "max_storage_mb": 1}, {"service_name": "free", "rate_limit_per_minute": 0, "daily_job_limit": 0, "max_storage_mb": 0}])
    files = table(spark, "files", [{"id": "1", "size": 900_000, "source_system": s} for s in ("service-a", "free", "new")])
    assert {r.service_name: r.over for r in c.storage_usage(files, policies, NOW, 200_000).collect()} == {"service-a": True, "free": False, "new": False}
    jobs = table(spark, "jobs", [{"id": str(i), "requested_by": s, "created_at": NOW + timedelta(minutes=i)} for s in ("service-a", "free") for i in range(2)])
    assert {r.service_name: r.exhausted for r in c.daily_job_usage(jobs, policies, NOW + timedelta(hours=5)).collect()} == {"service-a": True, "free": False}
    assert sorted((r.requested_by, r.id, r.admitted) for r in c.admit_daily(jobs, policies).collect()) == [("free", "0", True), ("free", "1", True), ("service-a", "0", True), ("service-a", "1", False)]


def test_hosts(spark):
    urls = spark.createDataFrame([(h,) for h in ("a.example.com", "example.com", "Hooks.Example.ORG.", "evil.com", None)], "host string")
    rules = spark.createDataFrame([("*.Example.com.",), ("hooks.example.org",), ("*",)], "rule string")
    assert [r.allowed for r in c.host_allowed(urls, rules).orderBy("host").collect()] == [False, True, True, False, False]


def test_webhooks_are_queued_once(spark):
    jobs = table(spark, "jobs", [{"id": "j", "status": "completed", "requested_by": "s"}, {"id": "k", "status": "running", "requested_by": "s"}])
    policies = table(spark, "service_policies", [{"service_name": "s", "webhook_url": "https://h"}])
    none = spark.createDataFrame([], "job_id string, event string")
    first = c.enqueue_webhooks(jobs, policies, none, NOW)
    assert [(r.job_id, r.event) for r in first.collect()] == [("j", "job.completed")]
    assert c.enqueue_webhooks(jobs, policies, first, NOW).count() == 0


def test_limits_come_before_filters(spark):
    ds = table(spark, "webhook_deliveries", [{"id": str(i), "status": "queued", "next_attempt_at": NOW + timedelta(minutes=i - 1), "created_at": NOW} for i in range(4)])
    assert sorted(names(c.due_deliveries(ds, NOW + timedelta(minutes=5), batch=2))) == ["0", "1"]


def test_routes_and_triage(spark):
    jobs = table(spark, "jobs", [{"id": "1", "operation": "ocr", "status": "failed", "error": "x"}, {"id": "2", "operation": "nonsense", "status": "failed"}])
    got = {r.id: (r.queue_class, r.time_limit_s, r.reject_reason) for r in c.route_operations(jobs).collect()}
    assert got == {"1": ("heavy", 3600, None), "2": (None, None, "unsupported")}
    triage = c.job_triage(jobs)
    assert len(triage.columns) == 8 and {r.id: r.failure_recorded for r in triage.collect()} == {"1": True, "2": False}


def test_leases_and_journal(spark):
    jobs = table(spark, "jobs", [{"id": str(i), "status": "running", "rq_job_id": f"q{i}", "lease_token": "t", "lease_epoch": 1, "lease_expires_at": NOW - timedelta(seconds=s)} for i, s in enumerate((300, 299, 900, 900))])
    queue = spark.createDataFrame([("q0", "failed"), ("q1", "failed"), ("q2", "started"), ("q3", "stopped")], "rq_job_id string, status string")
    journal = table(spark, "artifact_write_journal", [{"id": "x", "job_id": "3", "lease_epoch": 1, "state": "committed", "stored_name": "n"}])
    assert names(c.stalled_leases(jobs, queue, journal, NOW)) == ["0"]
    rows = [("a", "j", "t", "n1"), ("b", "j", "t", "n2"), ("c", "j", "t", "n3"), ("e", "k", "t", "n1"), ("f", "j", "u", "n2"), ("g", "j", "t", "n4")]
    planned = table(spark, "artifact_write_journal", [{"id": i, "job_id": j, "lease_token": t, "stored_name": n, "state": "planned"} for i, j, t, n in rows] + [{"id": "d", "stored_name": "d", "state": "committed"}])
    key = "job_id string, lease_token string, stored_name string"
    cleanup = spark.createDataFrame([("j", "t", "n2", True), ("j", "t", "n2", True), ("j", "t", "n3", False), ("j", "t", "n4", True), ("j", "t", "n4", None)], f"{key}, succeeded boolean")
    got = c.settle_journal(planned, spark.createDataFrame([("j", "t", "n1"), ("j", "t", "n1")], key), cleanup)
    assert sorted((r.id, r.state) for r in got.collect()) == [("a", "committed"), ("b", "compensated"), ("c", "needs_review"), ("e", "needs_review"), ("f", "needs_review"), ("g", "needs_review")]


def test_scopes(spark):
    keys = spark.createDataFrame([("k", '["a","x"]', "admin"), ("l", "broken", "viewer"), ("m", None, None)], "id string, scopes_json string, role string")
    got = {r.id: (r.scopes, r.invalid) for r in c.scope_audit(keys, {"viewer": ["a"]}, ["a"]).collect()}
    assert got == {"k": (["*", "a", "x"], ["x"]), "l": (["a"], []), "m": ([], [])}


def test_retry_needs_all_inputs(spark, files):
    jobs = table(spark, "jobs", [{"id": "1", "status": "failed", "operation": "merge", "input_file_ids_json": '["Alpha","gone"]'}, {"id": "2", "status": "cancelled", "operation": "merge", "input_file_ids_json": '["Alpha"]'}, {"id": "3", "status": "failed", "operation": "protect", "input_file_ids_json": '["Alpha"]'}])
    assert names(c.retryable(jobs, files)) == ["2"]
    assert c.job_status_counts(jobs).agg(F.sum("n")).first()[0] == 3


def test_manifest_rows_move_whole_files_once(spark):
    jobs = table(spark, "jobs", [{"id": i, "operation": "split-to-zip", "status": "completed", "output_file_id": f"p{i}", "requested_by": "o"} for i in "uvwxyz"])
    files = table(spark, "files", [{"id": f"{k}{i}", "original_name": f"{k}.bin", "source_system": "s" if k + i == "au" else "o", "content_type": "image/png" if k + i == "pv" else "application/zip", "size": 5, "sha256": "s"} for k in "pab" for i in "uvwxyz" if k + i != "bw"])
    links = [("u", "p", "bundle", None), ("u", "a", "part", 1), ("v", "p", "bundle", None), ("w", "p", "bundle", None), ("w", "b", "part", 1), ("x", "p", "bundle", None), ("x", "a", "part", 1), ("x", "p", "part", 2), ("y", "p", "bundle", None), ("y", "a", "part", 1), ("y", "b", "part", 1)]
    rows = c.manifest_rows(jobs, table(spark, "job_output_artifacts", [{"job_id": j, "file_id": f + j, "role": r, "ordinal": n} for j, f, r, n in links]), files)
    assert sorted((r.job_id, r.position, r.file_id, r.role) for r in rows.collect()) == [("x", 1, "px", "bundle"), ("x", 2, "px", "part"), ("x", 3, "ax", "part"), ("z", 1, "pz", "bundle")]
    plan = spark._jvm.PythonSQLUtils.explainString(rows.select("*")._jdf.queryExecution(), "formatted")
    assert len([x for x in plan.split("\n\n") if "Exchange" in x.split("\n")[0] and "sha256" in x]) == 1
