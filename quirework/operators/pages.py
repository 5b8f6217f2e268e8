"""Page plans and page geometry: ranges, deletion, order, merging, rotation, labels, placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENDPOINT = "(?:[1-9][0-9]{0,5}|z)"
RANGE = rf"^{ENDPOINT}(?:-{ENDPOINT})?(?:,{ENDPOINT}(?:-{ENDPOINT})?)*$"
MOST_PARTS, MOST_PAGES, HIGHEST = 80, 200, 100_000
#: Page sizes in points.
SIZES = {"a4": (210 * 72 / 25.4, 297 * 72 / 25.4), "letter": (612.0, 792.0)}
LEAST_SIDE, MOST_SIDE = 10, 14400


def range_pages(expression: Column, total: Column) -> tuple[Column, Column]:
    """The pages of a range expression in order, and the reason if it is refused."""
    well_formed = F.length(expression).between(1, 256) & expression.rlike(RANGE)
    number = lambda e: F.when(e == "z", total).otherwise(e.try_cast("int"))
    parts = F.transform(F.split(expression, ","), lambda s: F.split(s, "-"))
    ends = F.transform(parts, lambda p: F.struct(number(p[0]).alias("a"), number(F.element_at(p, -1)).alias("b")))
    size = F.aggregate(ends, F.lit(0), lambda n, e: n + F.abs(e["b"] - e["a"]) + 1)
    outside = F.exists(ends, lambda e: ~e["a"].between(1, total) | ~e["b"].between(1, total))
    pages = F.flatten(F.transform(ends, lambda e: F.sequence(e["a"], e["b"])))
    fine = F.coalesce(well_formed, F.lit(False)) & total.between(1, MOST_PAGES) & ~outside & (size <= 200 * MOST_PAGES)
    distinct = F.size(F.array_distinct(pages)) == F.size(pages)
    reason = (
        F.when(~F.coalesce(well_formed, F.lit(False)), "malformed")
        .when(~F.coalesce(total.between(1, MOST_PAGES), F.lit(False)), "source pages")
        .when(outside, "outside")
        .when(~distinct, "duplicate")
        .when(F.size(pages) > MOST_PARTS, "too many parts")
    )
    return F.when(fine & distinct & (F.size(pages) <= MOST_PARTS), pages), reason


def resolve_pages(requests: DataFrame, page_counts: DataFrame) -> DataFrame:
    """SET1: plan_id, doc_id, pages (NULL if refused) and reason."""
    rows = requests.join(page_counts.select("doc_id", F.col("pages").cast("int").alias("total")), "doc_id", "left")
    pages, reason = range_pages(F.col("expression"), F.col("total"))
    return rows.select("plan_id", "doc_id", pages.alias("pages"), reason.alias("reason"))


def page_counts(doc_pages: DataFrame) -> DataFrame:
    return doc_pages.groupBy("doc_id").agg(F.count("*").alias("pages"))


def _numbered(rows: DataFrame, *by: str) -> DataFrame:
    return rows.withColumn("new_page", F.row_number().over(Window.partitionBy("plan_id").orderBy(*by)))


def delete_pages(doc_pages: DataFrame, plan: DataFrame) -> DataFrame:
    """SET2: the pages that stay, renumbered. plan: plan_id, doc_id, pages. Plans that leave nothing give no rows."""
    gone = plan.select("plan_id", "doc_id", F.explode("pages").alias("page_no"))
    rows = doc_pages.select("doc_id", "page_no").join(plan.select("plan_id", "doc_id"), "doc_id")
    return _numbered(rows.join(gone, ["plan_id", "doc_id", "page_no"], "left_anti"), "page_no")


def organize_pages(doc_pages: DataFrame, plan: DataFrame, permutation: bool = False) -> DataFrame:
    """SET3: pages in a new order with rotation added. plan: plan_id, doc_id, pages array<struct<page, rotation>>.

    With permutation, plans that aren't one are refused; otherwise pages may be left out or repeated. A page that
    doesn't exist or a rotation that isn't a quarter turn refuses the plan.
    """
    counts = page_counts(doc_pages).withColumnRenamed("pages", "total")
    numbers = F.transform("pages", lambda p: p["page"].cast("int"))
    good = ~F.exists("pages", lambda p: ~p["page"].between(1, F.col("total")) | (F.pmod(p["rotation"], F.lit(90)) != 0)) & (F.size("pages") > 0)
    if permutation:
        good = good & (F.array_sort(numbers) == F.sequence(F.lit(1), F.col("total").cast("int")))
    chosen = plan.join(counts, "doc_id").where(good).select("plan_id", "doc_id", F.posexplode("pages").alias("at", "p"))
    rows = chosen.select("plan_id", "doc_id", "at", F.col("p.page").cast("int").alias("page_no"), F.col("p.rotation").alias("turn"))
    out = rows.join(doc_pages.select("doc_id", "page_no", "rotation"), ["doc_id", "page_no"])
    return out.select("plan_id", "doc_id", "page_no", (F.col("at") + 1).alias("new_page"), F.pmod(F.col("rotation") + F.col("turn"), F.lit(360)).alias("rotation"))


def merge_documents(doc_pages: DataFrame, plan: DataFrame) -> DataFrame:
    """SET4: one page sequence of 2 to 50 documents. plan: plan_id, doc_ids."""
    inputs = plan.where(F.size("doc_ids").between(2, 50)).select("plan_id", F.posexplode("doc_ids").alias("input_pos", "doc_id"))
    return _numbered(inputs.join(doc_pages.select("doc_id", "page_no"), "doc_id"), "input_pos", "page_no")


def rotate_pages(doc_pages: DataFrame, plan: DataFrame) -> DataFrame:
    """SET5: rotation after the plan (plan_id, doc_id, pages, degrees)."""
    turned = plan.where(F.col("degrees").isin(-270, -180, -90, 90, 180, 270)).select("plan_id", "doc_id", "degrees", "pages")
    rows = doc_pages.join(turned, "doc_id")
    hit = F.array_contains("pages", F.col("page_no"))
    return rows.select("plan_id", "doc_id", "page_no", F.when(hit, F.pmod(F.col("rotation") + F.col("degrees"), F.lit(360))).otherwise(F.col("rotation")).alias("rotation"))


def split_parts(plan: DataFrame) -> DataFrame:
    """SET6: one named part per selected page. plan: plan_id, doc_id, pages."""
    rows = plan.where("pages IS NOT NULL").select("plan_id", "doc_id", F.posexplode("pages").alias("at", "page_no"))
    return rows.select("plan_id", "doc_id", "page_no", (F.col("at") + 1).alias("ordinal"), F.format_string("part-%04d-page-%04d.pdf", F.col("at") + 1, "page_no").alias("name"))


def page_labels(doc_pages: DataFrame, template: str = "{page} / {total}", start: int = 1) -> DataFrame:
    """WIN7: labels with {page} and {total}; {{ and }} are braces, anything else in braces is an error."""
    import string

    parts: list[Column] = []
    per = Window.partitionBy("doc_id")
    values = {"page": F.row_number().over(per.orderBy("page_no")) - 1 + start, "total": F.count("*").over(per)}
    for literal, field, spec, conversion in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if field not in values or spec or conversion:
                raise ValueError("only plain {page} and {total} can be used")
            parts.append(values[field].cast("string"))
    return doc_pages.select("doc_id", "page_no", F.concat(*parts).alias("label") if parts else F.lit("").alias("label"))


def place_text(pages: DataFrame, position: str, margin: float) -> DataFrame:
    """GEO1: x, y and alignment of a text at one of seven places."""
    x, align = (F.lit(float(margin)), "left") if position.endswith("left") else (F.col("width") - margin, "right") if position.endswith("right") else (F.col("width") / 2, "center")
    y = F.col("height") - margin if position.startswith("top") else F.lit(float(margin)) if position.startswith("bottom") else F.col("height") / 2
    return pages.withColumns({"x": x, "y": y, "align": F.lit(align)})


def place_stamp(pages: DataFrame, stamp_width: float, stamp_height: float, position: str, margin: float) -> DataFrame:
    """GEO1: lower left corner of a stamp, on the page."""
    x = F.lit(float(margin)) if position.endswith("left") else F.col("width") - stamp_width - margin if position.endswith("right") else (F.col("width") - stamp_width) / 2
    y = F.col("height") - stamp_height - margin if position.startswith("top") else F.lit(float(margin)) if position.startswith("bottom") else (F.col("height") - stamp_height) / 2
    return pages.withColumns({"x": F.greatest(F.lit(0.0), x), "y": F.greatest(F.lit(0.0), y)})


def fit_images(images: DataFrame, page_size: str = "auto", fit: str = "contain", margin: float = 18, dpi: int = 150) -> DataFrame:
    """GEO2: page and drawing size of each image, centred."""
    if fit not in ("contain", "cover") or page_size not in ("auto", *SIZES):
        raise ValueError("fit is contain or cover; page_size is auto, a4 or letter")
    w, h = F.col("width_px") * 72.0 / dpi, F.col("height_px") * 72.0 / dpi
    pw, ph = (w + margin * 2, h + margin * 2) if page_size == "auto" else map(F.lit, SIZES[page_size])
    sx, sy = F.greatest(F.lit(1.0), pw - margin * 2) / w, F.greatest(F.lit(1.0), ph - margin * 2) / h
    scale = (F.least if fit == "contain" else F.greatest)(sx, sy)
    out = images.where("width_px > 0 AND height_px > 0").withColumns({"page_w": pw, "page_h": ph, "draw_w": w * scale, "draw_h": h * scale})
    return out.withColumns({"x": (F.col("page_w") - F.col("draw_w")) / 2, "y": (F.col("page_h") - F.col("draw_h")) / 2})


def crop_pages(pages: DataFrame, box: tuple[float, float, float, float], selected: list[int] | None = None) -> DataFrame:
    """GEO3: crop box of the selected pages and the reason if a page's can't be cropped so."""
    x0, y0, x1, y1 = map(float, box)
    sides = LEAST_SIDE <= x1 - x0 <= MOST_SIDE and LEAST_SIDE <= y1 - y0 <= MOST_SIDE
    chosen = F.lit(True) if selected is None else F.col("page_no").isin(selected)
    inside = F.lit(x0 >= -1e-6 and y0 >= -1e-6) & (F.lit(x1) <= F.col("width") + 1e-6) & (F.lit(y1) <= F.col("height") + 1e-6)
    reason = F.when(chosen & F.lit(not sides), "side out of bounds").when(chosen & ~inside, "outside the page")
    hit = chosen & reason.isNull()
    return pages.withColumns({"crop_w": F.when(hit, x1 - x0).otherwise(F.col("width")), "crop_h": F.when(hit, y1 - y0).otherwise(F.col("height")), "reason": reason})


def resize_pages(pages: DataFrame, width: float, height: float) -> DataFrame:
    """GEO3: scale factors to an exact size."""
    if not (LEAST_SIDE <= width <= MOST_SIDE and LEAST_SIDE <= height <= MOST_SIDE):
        raise ValueError("sides are 10 to 14400 points")
    ok = (F.col("width") > 0) & (F.col("height") > 0)
    return pages.withColumns({"scale_x": F.when(ok, F.lit(float(width)) / F.col("width")), "scale_y": F.when(ok, F.lit(float(height)) / F.col("height")), "reason": F.when(~ok, "invalid source geometry")})
