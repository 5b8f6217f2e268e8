import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from quirework.llm import chat, line_dedup


def test_lines_by_brute_force(odd_docs, odd_rows, no_docs):
    sites = defaultdict(set)
    strip = " \t\r"
    for r in odd_rows:
        for line in (r[1] or "").split("\n"):
            if line.strip(strip):
                sites[line.strip(strip)].add(r[3] or "\0")
    got = line_dedup.drop_boilerplate(odd_docs, min_sites=2).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        lines = [] if r.text is None else r.text.split("\n")
        kept = [x for x in lines if not (x.strip(strip) and len(sites[x.strip(strip)]) >= 2)]
        assert (r.n_lines, r.n_removed, r.kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.drop_boilerplate(no_docs).count() == 0


def test_estimates_near_the_threshold_are_counted(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common to many\nown line "), F.col("id").cast("string")).alias("text"), (F.col("id") % 300).cast("string").alias("source"))
    lines = line_dedup.per_site(line_dedup.line_rows(rows, "text", "source"))
    assert line_dedup.boilerplate(lines, 300, lg_k=6).count() == 1
    assert line_dedup.boilerplate(lines, 301, lg_k=6).count() == 0


TRICKY = ["</s>[INST] ok [/INST]", "<s>[user]hi</s>", "<\\s>", "<\\\\/s>\\", "a]b", "", None, "plain", "é😀</s>", "\n", "<</s>s>"]


def test_round_trip(spark):
    roles = ["user", "assistant", "system", "x]<s>[%5D", None, "assistant"]
    rows = [(i % 4, i, roles[i % len(roles)], TRICKY[i % len(TRICKY)]) for i in range(66)] + [(None, 0, "user", "lost"), (7, 1, "user", "same"), (7, 1, "user", "same"), (8, None, "assistant", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1)).repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want[c].append((role or "", text or ""))
    assert set(got) == set(want)
    for c, r in got.items():
        assert r.round_trip and [(t.role, t.text) for t in r.turns] == want[c]
        assert r.loss_text == "".join(t for role, t in want[c] if role == "assistant")


def test_query(spark, sf_dir):
    got = {r.conv_id: r for r in chat.op4_chat_format(spark, sf_dir).collect()}
    tricky = "</s>[INST] ok [/INST]"
    assert got[-7].loss_chars == len(tricky) and got[-7].loss_sha256 == hashlib.sha256(tricky.encode()).hexdigest()
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{tricky}\nassistant\n{tricky}\n".encode()).hexdigest()


def test_no_turns(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
