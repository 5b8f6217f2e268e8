"""Layout operators: ruled tables, reading order, archive members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS, LEAST_STROKE, LEAST_GAP = 1.0, 10.0, 12.0
MOST_COLUMNS, MOST_ROWS = 12, 60
#: Limits on archives.
ENTRIES, ENTRY_BYTES, TOTAL_BYTES, EXPANSION = 2048, 64 * 1024 * 1024, 256 * 1024 * 1024, 1000
STORED, DEFLATED = 0, 8


def grids(rules: DataFrame) -> DataFrame:
    """page_id and the ascending places xs and ys of the lines, for pages whose rules make a whole grid."""
    strokes = rules.where(F.col("hi") - F.col("lo") >= LEAST_STROKE).withColumn("pos", F.round("pos", 2))
    lines = strokes.groupBy("page_id", "axis", "pos").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    axis = lines.groupBy("page_id", "axis").agg(F.sort_array(F.collect_list("pos")).alias("at"), F.flatten(F.collect_list(F.transform("parts", lambda p: p))).alias("all"), F.collect_list("parts").alias("lines"))
    of = lambda name: F.first(F.when(F.col("axis") == name, F.struct("at", "all", "lines")), ignorenulls=True).alias(name)
    both = axis.groupBy("page_id").agg(of("x"), of("y")).where("x IS NOT NULL AND y IS NOT NULL")
    both = both.select("page_id", *[F.col(f"{n}.{f}").alias(c) for n in "xy" for f, c in (("at", f"{n}s"), ("all", f"{n}_all"), ("lines", f"{n}_lines"))])

    def gaps(a: str):
        return ~F.exists(F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.get(F.col(a), i) - F.get(F.col(a), i - 1)), lambda g: g < LEAST_GAP)

    def spans(lines: str, all_: str, other: str):
        lo, hi = F.get(F.col(other), F.lit(0)), F.element_at(other, -1)
        whole = ~F.exists(F.col(lines), lambda parts: ~F.exists(parts, lambda p: (p["lo"] <= lo + EPS) & (p["hi"] >= hi - EPS)))
        return whole & ~F.exists(F.col(all_), lambda p: (p["lo"] < lo - EPS) | (p["hi"] > hi + EPS))

    sized = F.size("xs").between(3, MOST_COLUMNS + 1) & F.size("ys").between(3, MOST_ROWS + 1)
    return both.where(sized).where(gaps("xs") & gaps("ys") & spans("x_lines", "x_all", "ys") & spans("y_lines", "y_all", "xs")).select("page_id", "xs", "ys")


def grid_bands(rules: DataFrame) -> DataFrame:
    """WIN9: page_id, axis, band, lo, hi of the cells' columns and rows, for pages whose rules make a whole grid."""
    good = grids(rules)

    def bands(name: str, at: str):
        return good.select("page_id", F.lit(name).alias("axis"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda i: F.struct(F.get(F.col(at), i).alias("lo"), F.get(F.col(at), i + 1).alias("hi")))).alias("band", "b")).select("page_id", "axis", "band", "b.lo", "b.hi")

    return bands("x", "xs").union(bands("y", "ys"))


def assign_cells(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """JOIN18: page_id, row, col, text of whole tables; rows count from the top.

    One join by page, whose lines come as arrays; a span's band is found in them. A page is refused if a span lies outside
    the table, two share a cell, one looks like a formula, a header cell is empty or a row is.
    """
    def band(v: str, at: str) -> Column:
        """The band of the ascending lines `at` that a value lies inside."""
        i = F.size(F.filter(at, lambda line: line + EPS <= F.col(v))) - 1
        return F.when(i.between(0, F.size(at) - 2) & (F.col(v) <= F.get(F.col(at), i + 1) - EPS), i)

    said = spans.where(F.btrim("text") != "").select("page_id", "seq", "x", "y", F.btrim("text").alias("text"))
    held = said.join(grids(rules), "page_id").withColumns({"n_cols": F.size("xs") - 1, "n_rows": F.size("ys") - 1, "col": band("x", "xs"), "row_up": band("y", "ys")}).drop("xs", "ys")
    held = held.withColumn("row", F.col("n_rows") - 1 - F.col("row_up"))
    page = Window.partitionBy("page_id")
    bad = F.col("col").isNull() | F.col("row").isNull() | unsafe("text")
    cell = F.struct("row", "col")
    held = held.withColumns({"bad": F.max(bad).over(page), "n": F.count("*").over(page), "cells": F.size(F.collect_set(cell).over(page)), "heads": F.size(F.collect_set(F.when(F.col("row") == 0, F.col("col"))).over(page)), "full": F.size(F.collect_set("row").over(page))})
    whole = held.where("NOT bad AND n = cells AND heads = n_cols AND full = n_rows")
    return whole.select("page_id", F.col("row").cast("int").alias("row"), "col", "text")


def unsafe(c: str):
    """FLT12: text that a spreadsheet would take for a formula."""
    return F.col(c).rlike("^\\s*[=+\\-@]")


def unsafe_cells(cells: DataFrame) -> DataFrame:
    """FLT12: per page, whether any cell could be taken for a formula."""
    return cells.groupBy("page_id").agg(F.bool_or(unsafe("text")).alias("rejected"))


def plain_lines(spans: DataFrame) -> DataFrame:
    """WIN6: page_id, accepted and reason: one column of text, read downwards."""
    w = Window.partitionBy("page_id").orderBy("seq")
    rows = spans.withColumns({"first_x": F.first("x").over(w), "above": F.lag("y").over(w)})
    aside = F.abs(F.col("x") - F.col("first_x")) > 8
    unordered = F.coalesce(F.col("y") >= F.col("above") - 0.5, F.lit(False))
    rows = rows.withColumn("why", F.when(aside, "columns or indents").when(unordered, "order is ambiguous"))
    return rows.groupBy("page_id").agg(F.min_by("why", F.when(F.col("why").isNotNull(), F.col("seq"))).alias("reason"), F.count("*").alias("lines")).select("page_id", F.col("reason").isNull().alias("accepted"), "reason", "lines")


def audit_archives(members: DataFrame) -> DataFrame:
    """AGG13: per archive its entries, bytes, accepted and reasons (sorted)."""
    name, low = F.col("name"), F.lower("name")
    parts = F.split(F.rtrim(name, F.lit("/")), "/")
    kind = F.col("mode").bitwiseAND(0o170000)
    path = (name == "") | name.startswith("/") | name.contains("\\") | name.contains(":") | F.exists(parts, lambda p: p.isin("", ".", "..")) | name.rlike("[\\x00-\\x1f\\x7f]")
    flags = {
        "unsafe path": path,
        "special file": ~kind.isin(0, 0o100000, 0o040000) | ((kind == 0o040000) & ~F.col("is_dir")),
        "encrypted": F.col("flag_bits").bitwiseAND(1) == 1,
        "compression": ~F.col("compress_type").isin(STORED, DEFLATED),
        "entry too large": F.col("file_size") > ENTRY_BYTES,
        "expansion": F.col("file_size") > (F.col("compress_size") + 1024) * EXPANSION,
        "macros": low.endswith("vbaproject.bin") | F.concat(F.lit("/"), low).contains("/activex/"),
        "duplicate name": F.count("*").over(Window.partitionBy("archive_id", low)) > 1,
    }
    rows = members.withColumn("why", F.array_compact(F.array(*[F.when(c, k) for k, c in flags.items()])))
    out = rows.groupBy("archive_id").agg(F.count("*").alias("entries"), F.sum("file_size").alias("bytes"), F.array_distinct(F.flatten(F.collect_set("why"))).alias("why"))
    more = F.array_compact(F.array(F.when(F.col("entries") > ENTRIES, "too many entries"), F.when(F.col("bytes") > TOTAL_BYTES, "too large")))
    return out.select("archive_id", "entries", "bytes", F.array_sort(F.concat("why", more)).alias("reasons")).withColumn("accepted", F.size("reasons") == 0)


def natural_order(members: DataFrame) -> DataFrame:
    """TOP5: page ordinals with digit runs compared as numbers, letters without case, then the name itself.

    A name is cut to text and digit runs in turn, text first (it may be empty), so equal places hold equal kinds.
    """
    low = F.lower("name")
    pairs = F.regexp_extract_all(low, F.lit("([^0-9]*)([0-9]*)"), F.lit(0))
    key = F.transform(F.filter(pairs, lambda p: p != ""), lambda p: F.struct(F.regexp_extract(p, "^([^0-9]*)", 1).alias("t"), F.length(F.regexp_replace(F.regexp_extract(p, "([0-9]*)$", 1), "^0+", "")).alias("n"), F.regexp_replace(F.regexp_extract(p, "([0-9]*)$", 1), "^0+", "").alias("d")))
    return members.withColumn("ordinal", F.row_number().over(Window.partitionBy("archive_id").orderBy(key, "name", "seq")))
