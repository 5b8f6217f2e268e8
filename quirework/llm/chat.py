r"""Chat formatting, made safe by a grammar round trip.

Grammar: a conversation is a row of turns, a turn is ``<s>[role]text</s>``. The parser is one regular expression;
it takes a text up to the next ``</s>``. Each conversation is first rendered with its texts as they are, parsed
again and compared with the source turns. If they differ, a text holds something that the parser takes for a mark;
the conversation is then rendered with such content escaped, and checked again: in ``<``, any number of ``\``,
``s>`` or ``/s>``, one more ``\`` is put in, and the parser takes one out. The escape is reversible for every text,
and no escaped text holds a mark. `round_trip` says that the parsed turns are the source turns.

Rules: null text or role counts as empty; ``%``, ``[``, ``]`` and ``<`` in a role become %25, %5B, %5D and %3C. Turns
are ordered by turn (nulls first), ties by role and text; repeated rows stay. A null conv_id is one conversation.
Extra columns are ignored. The loss mask holds the texts of assistant turns. An empty table gives an empty one; very
long texts are escaped and read back whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import table

#: Parser and escape.
TURN = r"(?s)<s>\[([^\]]*)\](.*?)</s>"
ROLE_CODES = [("%", "%25"), ("[", "%5B"), ("]", "%5D"), ("<", "%3C")]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?s>)", r"<$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?s>)", "<$1$2")


def role_code(role: Column) -> Column:
    for a, b in ROLE_CODES:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def role_name(code: Column) -> Column:
    for a, b in reversed(ROLE_CODES):
        code = F.replace(code, F.lit(b), F.lit(a))
    return code


def parts(turns: Column, escaped: bool) -> Column:
    """Each turn as struct(mark, body)."""
    return F.transform(turns, lambda t: F.struct(F.concat(F.lit("<s>["), role_code(t["role"]), F.lit("]")).alias("mark"), (escape(t["text"]) if escaped else t["text"]).alias("body")))


def render(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["mark"], p["body"], F.lit("</s>"))), "")


def parse(formatted: Column) -> Column:
    """The turns in a formatted conversation, as array<struct<role, text>>."""
    roles = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(role_name(r).alias("role"), unescape(t).alias("text")))


def spans(pieces: Column) -> Column:
    """Start and end, in code points, of the bodies of assistant turns in the formatted text."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["mark"])
        end = start + F.length(p["body"])
        hit = F.when(p["mark"] == "<s>[assistant]", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + F.lit(4)).alias("at"), F.concat(acc["found"], hit).alias("found"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["found"])


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (the loss mask), round_trip for each conversation."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    chats = chats.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = chats.withColumn("plain", render(parts(F.col("turns"), False)))
    tried = plain.withColumn("same", parse(F.col("plain")) == F.col("turns"))
    pieces = F.when(F.col("same"), parts(F.col("turns"), False)).otherwise(parts(F.col("turns"), True))
    done = tried.withColumn("pieces", pieces).withColumn("formatted", render(F.col("pieces"))).withColumn("loss_spans", spans(F.col("pieces")))
    return done.select("conv_id", "formatted", "loss_spans", (F.col("same") | (parse(F.col("formatted")) == F.col("turns"))).alias("round_trip"))


def read_back(chats: DataFrame) -> DataFrame:
    """Add what the formatted text says: its turns, and the unescaped text under the loss mask."""
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return chats.withColumn("turns", parse(F.col("formatted"))).withColumn("loss_text", F.array_join(under, ""))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    chats = read_back(format_chats(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op4_chat_format": op4_chat_format}
ORACLES = {
    "op4_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
             g AS (SELECT conv_id, count(*) AS n_turns,
                          string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                          coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
                          sum(length(role) + length(regexp_replace(text, '<(\\*)(/?s>)', '<\1\\\2', 'g')) + 9) AS formatted_chars
                   FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
               formatted_chars::BIGINT AS formatted_chars FROM g"""
}
