"""Queries that read whole texts and whole tables, against brute force on tables with long and odd rows."""

import duckdb

from quirework.operators import text
from quirework.plans import registry


def test_summaries_of_fragments_without_tokens(spark, tmp_path):
    rows = ["é é é é é é é é é", *(f"water {w} gates and canals" for w in "abcdefghij"), "ö ö ö ö ö ö ö ö ö"]
    spark.createDataFrame([(7, "\n".join(rows), "en", "src1", 400)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["win2_extractive_summary"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()["win2_extractive_summary"])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
    # unless asked otherwise, such a fragment has only the score of its place
    pages = spark.createDataFrame([("7", 1, "\n".join(rows))], "doc_id string, page_no int, text string")
    assert text.extractive_summary(text.fragments(pages), 12).where("idx = 0").first().score == 2.0


def test_whole_evidence(spark, tmp_path):
    spark.createDataFrame([(0, "The irrigation controller sends alerts.\nNothing else is written here.", "en", "src1", 70)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    late = "Please be so kind and tell me after all of these idle words about irrigation"
    turns = [(0, 0, "user", f"{late}. And zzz?\n\n{'irrigation ' * 30}"), (0, 1, "assistant", "irrigation"), (0, 2, "user", "Qqq")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.question_id, r.idx, r.fallback) for r in registry.queries()["win3_evidence"](spark, str(tmp_path)).collect()}
    assert late.index("irrigation") > 60
    assert got == {("0-0-0", 0, False), ("0-0-1", 0, True)}


def test_whole_merges(spark, sf_dir):
    merged = {r.doc_id for r in registry.queries()["set4_merged_documents"](spark, sf_dir).select("doc_id").distinct().collect()}
    assert merged == {str(r.doc_id) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id").collect()}


def test_whole_reconcile(spark, sf_dir):
    issues = registry.queries()["join1_reconcile"](spark, sf_dir)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert parts > 50 and issues.where("category = 'orphan_object' AND stored_name LIKE 'part-%'").count() == parts
    summary = registry.queries()["agg5_reconcile_summary"](spark, sf_dir).first()
    assert summary.orphan_object >= parts and "WHERE p_partkey < 50" not in registry.oracle_sql()["agg5_reconcile_summary"]


def test_whole_files(spark, tmp_path):
    long = "long line\n" * 900
    rows = [(5, long), (14, long), (15, long), (3, long), (6, long), (7, long), (8, long), (11, 'a,"b"\n\nc'), (1, "x" * 2001), (17, "y\n" * 999 + "y"), (10, None)]
    spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    audit, kinds = (registry.queries()[q](spark, str(tmp_path)).collect() for q in ("src7_manifest_audit", "txt3_media_types"))
    status = {int(r.case_id): r.status for r in audit}
    assert len(status) == len(rows)
    assert status == {5: "not a PDF", 14: "not a PDF", 15: "ok", 3: "ok", 6: "ok", 7: "ok", 8: "checksum mismatch", 11: "ok", 1: "ok", 17: "ok", 10: "missing file"}
    assert {r.doc_id: r.content_type for r in kinds} == {5: "image/webp", 14: None, 15: None, 3: "text/plain", 6: None, 7: None, 8: "application/pdf", 11: "text/plain", 1: None, 17: None, 10: None}
