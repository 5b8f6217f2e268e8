import hmac

import pytest
from pyspark.sql import functions as F

from quirework.functions import registry, text as ft, urls
from quirework.operators import layout, pages, text

GUIDE = [(1, "The irrigation controller monitors water temperature and dissolved oxygen.\nThe controller sends alerts when dissolved oxygen falls below the limit."), (2, "Students use the dashboard to inspect water temperature history.\nAccess controls prevent unauthorized downloads of school reports.")]


@pytest.fixture(scope="module")
def frags(spark):
    return text.fragments(spark.createDataFrame([("d", n, t) for n, t in GUIDE], "doc_id string, page_no int, text string"))


def ask(spark, frags, question, previous=None):
    q = spark.createDataFrame([("q", "d", question, previous)], "question_id string, doc_id string, question string, previous_question string")
    return text.evidence(frags, q).orderBy("rank").collect()


def test_evidence(spark, frags):
    assert {r.page_no for r in ask(spark, frags, "dissolved oxygen")} == {1}
    assert ask(spark, frags, "zebra migration") == []
    weak = ask(spark, frags, "zebra migration", "dissolved oxygen")
    assert {r.page_no for r in weak} == {1} and all(r.fallback for r in weak)
    strong = ask(spark, frags, "water temperature", "dissolved oxygen")
    assert 2 in {r.page_no for r in strong} and not any(r.fallback for r in strong)
    assert ask(spark, frags, "a\x01b question") == [] and ask(spark, frags, "?!") == []


def test_fragments_and_summary(spark, frags):
    assert [r.idx for r in frags.orderBy("idx").collect()] == [0, 1, 2, 3]
    assert text.extractive_summary(frags, 2).count() == 2
    long = spark.createDataFrame([("x", 1, "short\r\n" + "a" * 345 + "\x0bline  with\tspaces  here \n")], "doc_id string, page_no int, text string")
    assert [r.text for r in text.fragments(long).orderBy("idx").collect()] == ["a" * 340, "line with spaces here"]


def test_summary_is_shuffled_by_document_only(frags):
    plan = text.extractive_summary(frags)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and all("hashpartitioning(doc_id" in x and "token" not in x.split("hashpartitioning(")[1].split(")")[0] for x in exchanges)


@pytest.mark.parametrize(("s", "want"), [("a\r\nb\n\nc\n", ["a", "b", "", "c"]), ("", []), ("x\u2028y\x85", ["x", "y"]), (None, [])])
def test_lines(spark, s, want):
    assert spark.createDataFrame([(s,)], "s string").select(ft.lines("s")).first()[0] == want


@pytest.mark.parametrize(("s", "want"), [("../../etc/pass wd.pdf", "pass_wd.pdf"), ("", "upload.bin"), ("...", "upload.bin"), ("a b_.", "a_b"), (None, "upload.bin"), ("x" * 300, "x" * 180)])
def test_file_names(spark, s, want):
    assert spark.createDataFrame([(s,)], "s string").select(ft.safe_filename("s")).first()[0] == want


def test_escapes(spark):
    df = spark.createDataFrame([("a{b}\\\té😀<&'",)], "s string").select(ft.escape_rtf("s"), ft.escape_html("s")).first()
    assert df[0] == "a\\{b\\}\\\\\\tab \\u233?\\u-10179?\\u-8704?<&'"
    assert df[1].endswith("&lt;&amp;&#x27;")


@pytest.mark.parametrize(("expression", "want"), [("1", [1]), ("1,3,5", [1, 3, 5]), ("5-3", [5, 4, 3]), ("z-1", [5, 4, 3, 2, 1]), ("2-z", [2, 3, 4, 5]), *[(x, None) for x in ("", "0", "1,,2", "5-0", "6", "2,2", "1-3,3", "100001", "1,z,5", "3-6", "9999999")]])
def test_page_ranges(spark, expression, want):
    asked = spark.createDataFrame([("p", "d", expression)], "plan_id string, doc_id string, expression string")
    counts = spark.createDataFrame([("d", 5)], "doc_id string, pages long")
    got = pages.resolve_pages(asked, counts).first()
    assert got.pages == want and (got.reason is None) == (want is not None)


@pytest.fixture(scope="module")
def four_pages(spark):
    return spark.createDataFrame([("d", n, f"t{n}", 100.0, 200.0, 90 if n == 2 else 0) for n in range(1, 5)], "doc_id string, page_no int, text string, width double, height double, rotation int")


def test_page_plans(spark, four_pages):
    plan = spark.createDataFrame([("p", "d", [2, 4])], "plan_id string, doc_id string, pages array<int>")
    assert [(r.page_no, r.new_page) for r in pages.delete_pages(four_pages, plan).orderBy("new_page").collect()] == [(1, 1), (3, 2)]
    order = lambda *p: spark.createDataFrame([("p", "d", list(p))], "plan_id string, doc_id string, pages array<struct<page:int,rotation:int>>")
    got = pages.organize_pages(four_pages, order((2, 270), (2, 0), (1, -90))).orderBy("new_page").collect()
    assert [(r.page_no, r.rotation) for r in got] == [(2, 0), (2, 90), (1, 270)]
    assert pages.organize_pages(four_pages, order((2, 0), (1, 0)), permutation=True).count() == 0
    assert pages.organize_pages(four_pages, order((4, 0), (3, 0), (2, 0), (1, 0)), permutation=True).count() == 4
    assert pages.organize_pages(four_pages, order((1, 45))).count() == 0
    assert [r.label for r in pages.page_labels(four_pages, "{{{page}}} of {total}", 7).orderBy("page_no").collect()][:2] == ["{7} of 4", "{8} of 4"]
    with pytest.raises(ValueError):
        pages.page_labels(four_pages, "{author}")
    assert [r.name for r in pages.split_parts(plan).orderBy("ordinal").collect()] == ["part-0001-page-0002.pdf", "part-0002-page-0004.pdf"]


def test_geometry(spark, four_pages):
    assert pages.crop_pages(four_pages, (0, 0, 5, 50)).first().reason == "side out of bounds"
    assert pages.crop_pages(four_pages, (0, 0, 101, 50)).first().reason == "outside the page"
    r = pages.resize_pages(four_pages, 50, 400).first()
    assert (r.scale_x, r.scale_y) == (0.5, 2.0)
    assert pages.place_stamp(four_pages, 500, 10, "top-left", 5).first().x == 5.0 and pages.place_stamp(four_pages, 500, 10, "center", 5).first().x == 0.0
    images = spark.createDataFrame([("i", 300, 150)], "image_id string, width_px int, height_px int")
    i = pages.fit_images(images).first()
    assert (i.page_w, i.page_h, i.draw_w) == (180.0, 108.0, 144.0)


def replace(spark, runs, old, new):
    spans = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(runs)], "doc_id string, page_no int, seq int, text string")
    edits = spark.createDataFrame([("d", 1, old, new)], "doc_id string, page_no int, old_text string, new_text string")
    got = text.replace_once(spans, edits).orderBy("seq").collect()
    return [r.text for r in got], got[0].status


def test_replacements(spark):
    assert replace(spark, ["one cat", "two"], "cat", "dog") == (["one dog", "two"], "replaced")
    assert replace(spark, ["one ca", "t two"], "cat", "dog") == (["one do", "g two"], "replaced")
    assert replace(spark, ["cat", "cat"], "cat", "dog")[1] == "not unique"
    assert replace(spark, ["ca", "t cat"], "cat", "dog")[1] == "not unique"
    assert replace(spark, ["one"], "cat", "dog")[1] == "not found"
    assert replace(spark, ["cat"], "cat", "dogs")[1] == "invalid edit"


def test_transcripts_and_info(spark):
    p = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("e", 1, " \n")], "doc_id string, page_no int, text string")
    assert {r.doc_id: (r.text, r.error) for r in text.transcript(p).collect()} == {"d": ("a\n\f\nb", None), "e": (None, "no text")}
    assert text.transcript(p, "marked").where("doc_id = 'd'").first().text == "[Page 1]\na\n\n[Page 2]\nb"
    form = spark.createDataFrame([("d", {"a": "1", "b": "2"})], "doc_id string, fields map<string,string>")
    up = lambda m: spark.createDataFrame([("d", m)], "doc_id string, updates map<string,string>")
    assert text.fill_form(form, up({"a": "9"})).first().fields == {"a": "9", "b": "2"}
    assert text.fill_form(form, up({"zz": "9"})).first().reason == "unknown field"


def test_table_cells(spark):
    rules = [("p", "x", x, 0.0, 60.0) for x in (0.0, 50.0, 100.0)] + [("p", "y", y, 0.0, 100.0) for y in (0.0, 20.0, 40.0, 60.0)]
    rules = spark.createDataFrame(rules, "page_id string, axis string, pos double, lo double, hi double")
    said = [(5, 45, "Name"), (55, 45, "Qty"), (5, 25, "Apple n"), (55, 25, "5"), (5, 5, "Pear"), (55, 5, "8")]

    def cells(rows):
        spans = spark.createDataFrame([("p", i, float(x), float(y), t) for i, (x, y, t) in enumerate(rows)], "page_id string, seq int, x double, y double, text string")
        return [(r.row, r.col, r.text) for r in layout.assign_cells(spans, rules).orderBy("row", "col").collect()]

    assert cells(said) == [(0, 0, "Name"), (0, 1, "Qty"), (1, 0, "Apple n"), (1, 1, "5"), (2, 0, "Pear"), (2, 1, "8")]
    assert cells(said[1:]) == [] and cells([*said, (6, 45, "more")]) == [] and cells([*said, (150, 5, "out")]) == [] and cells([*said[:5], (55, 5, "=8")]) == []
    assert len(cells(said[:5])) == 5 and cells(said[:4]) == []


def test_archives(spark):
    rows = [("a", 1, "p10.png", 10, 10, 8, 0, 0, False), ("a", 2, "P2.png", 10, 10, 0, 0, 0, False), ("b", 1, "../x", 1, 1, 8, 0, 1, False), ("c", 1, "A.txt", 1, 1, 8, 0, 0, False), ("c", 2, "a.TXT", 1, 1, 9, 0, 0, False), ("c", 3, "word/vbaProject.bin", 9_000_000, 1, 8, 0o120000, 0, False)]
    members = spark.createDataFrame(rows, "archive_id string, seq int, name string, file_size long, compress_size long, compress_type int, mode int, flag_bits int, is_dir boolean")
    got = {r.archive_id: r.reasons for r in layout.audit_archives(members).collect()}
    assert got == {"a": [], "b": ["encrypted", "unsafe path"], "c": ["compression", "duplicate name", "expansion", "macros", "special file"]}
    assert [r.name for r in layout.natural_order(members).where("archive_id = 'a'").orderBy("ordinal").collect()] == ["P2.png", "p10.png"]


@pytest.mark.parametrize(("url", "host", "reason"), [("https://Example.com/a b", None, "length or characters"), ("https://Example.com:443/a", "example.com", None), ("http://example.com/", None, "not HTTPS"), ("https://u@example.com/", None, "credentials"), ("https://example.com/?q", None, "query"), ("https://10.0.0.1/", None, "IP address"), ("https://999.1.1.1/", "999.1.1.1", None), ("https://255.0.1.9/", None, "IP address"), ("https://localhost/x", None, "not public"), ("https://a.internal/x", None, "not public"), ("https://bücher.de/x", "xn--bcher-kva.de", None), ("https://-a.com/", None, "label"), ("https://example.com:8443/", None, "port"), ("https://a.com/%41", None, "encoded or bracketed"), (None, None, "length or characters")])
def test_urls(spark, url, host, reason):
    r = urls.validate_urls(spark.createDataFrame([(url,)], "url string")).first()
    assert (r.host, r.reason) == (host, reason)


@pytest.mark.parametrize(("url", "path"), [("https://a.com", "/"), ("https://a.com//x/é<b>:@", "//x/%C3%A9%3Cb%3E:@")])
def test_url_paths(spark, url, path):
    assert urls.validate_urls(spark.createDataFrame([(url,)], "url string")).first().path == path


def test_registry(spark, four_pages):
    with pytest.raises(ValueError):
        registry.apply_operation("nonsense", [four_pages])
    with pytest.raises(ValueError):
        registry.apply_operation("merge", [four_pages])
    out = registry.translate_pages(four_pages.union(four_pages.withColumn("doc_id", F.lit("e")).withColumn("text", F.when(F.col("page_no") == 3, "").otherwise("x"))), lambda t, a, b: t.upper(), "en", "th")
    assert {(r.doc_id, r.target_text) for r in out.collect()} == {("d", f"T{n}") for n in range(1, 5)}
    registry.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM page_range('3-1', 4)").collect()] == [(1, 3), (2, 2), (3, 1)]
    assert spark.sql("SELECT * FROM page_range('1', CAST(NULL AS INT))").count() == spark.sql("SELECT * FROM page_range('1', 201)").count() == 0
    assert spark.sql("SELECT doc_tokens('A bc, de1 é') t").first().t == ["bc", "de1"]


def test_sql_functions_say_what_the_columns_say(spark):
    registry.register(spark)
    cases = [(e, n) for e in ("1", "1-3,z", "z-1", "0", "1,,2", "2,2", "4", "1-81", "1-80", "100001", "1,z,5", "", None, ",".join(["1"] * 200), "-1", "z") for n in (3, 5, 200, 201, 0, None)]
    df = spark.createDataFrame(cases, "expression string, total int")
    same = df.select(pages.range_pages(F.col("expression"), F.col("total"))[0].alias("a"), F.expr("page_list(expression, total)").alias("b"))
    assert all(r.a == r.b for r in same.collect()) and same.where("a IS NOT NULL").count() >= 8
    texts = spark.createDataFrame([("a",), ("",), ("é ไทย",), (None,)], "s string")
    for key in ("k", "", "é" * 40, "x" * 64):
        want = [None if r.s is None else hmac.new(key.encode(), r.s.encode(), "sha256").hexdigest() for r in texts.collect()]
        assert [r[0] for r in texts.select(ft.hmac_hex("s", key.encode())).collect()] == want
        assert [r[0] for r in texts.select(F.call_function("hmac_hex", "s", F.lit(key))).collect()] == want
