"""Positioned text fragments to lines in reading order.

Everything that looks at neighbouring fragments works inside one page, so the
fragments are shuffled once by (exam, page) and keep that partitioning; fragments that
are stored by page are not shuffled. They meet tables of pages by hash, so that they are
sorted only where lines are made of them, and what a task keeps are the pages of its partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlens.config import LAYOUT, Layout
from examlens.functions.ordered import position
from examlens.functions.text import trimmed, zone_key
from examlens.sources.sinks import materialize

PAGE = ["exam_id", "page"]


def _by_page(pages: DataFrame) -> DataFrame:
    """A table of pages that fragments meet: neither sorted nor sent to all tasks."""
    return pages.hint("shuffle_hash")


def normalize_fragments(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """A3: blank strings dropped, y from the top, one decimal, height from the font if unknown."""
    one = lambda c: F.round(c, 1)
    has_height = "height" in raw.columns
    height = F.nullif(F.col("height"), F.lit(0.0)) if has_height else F.lit(None).cast("double")
    keep = [c for c in raw.columns if c not in ("x", "y", "width", "height", "font_size")]
    font = F.abs(F.col("font_size"))
    return (
        raw.filter(trimmed(F.col("str")) != "")
        .join(_by_page(pages.select(*PAGE, "page_height")), PAGE)
        .select(
            *keep,
            one(F.col("x")).alias("x"),
            one(F.col("page_height") - F.col("y")).alias("y"),
            one(F.coalesce("width", F.lit(0.0))).alias("width"),
            one(F.coalesce(height, font)).alias("height"),
            one(font).alias("font_size"),
        )
    )


def clip_page_range(df: DataFrame, pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """A4: rows on the wanted pages; ``ranges(exam_id, page_start, page_end)``.

    The page table is filtered by the exam's range first; rows then only meet
    pages that are wanted.
    """
    last = pages.groupBy("exam_id").agg(F.max("page").alias("_n"))
    ok = lambda c: F.when(F.col(c) > 0, F.col(c))
    start = F.least(F.coalesce(ok("page_start"), F.lit(1)), F.col("_n"))
    end = F.least(F.coalesce(ok("page_end"), F.col("_n")), F.col("_n"))
    bounds = last.join(ranges.select("exam_id", "page_start", "page_end"), "exam_id", "left").select(
        "exam_id", start.alias("_from"), F.greatest(start, end).alias("_to")
    )
    wanted = pages.select(*PAGE).join(bounds, "exam_id").filter(F.col("page").between(F.col("_from"), F.col("_to")))
    return df.join(_by_page(wanted.select(*PAGE)), PAGE, "left_semi")


def tag_zones(fragments: DataFrame, pages: DataFrame, cfg: Layout = LAYOUT) -> DataFrame:
    """B1: header or footer zone by height on the page."""
    rel = F.col("y") / F.col("page_height")
    return fragments.join(_by_page(pages.select(*PAGE, "page_height")), PAGE, "left").select(
        *fragments.columns,
        F.when(rel < cfg.header_zone, "header").when(rel > 1 - cfg.footer_zone, "footer").alias("zone"),
    )


def _on_most_pages(keys: DataFrame, pages: DataFrame, cfg: Layout) -> DataFrame:
    """``keys(exam_id, page, str_key)`` without repeats, to the strings on most pages."""
    counts = keys.filter(F.length("str_key") >= 2).groupBy("exam_id", "str_key").agg(F.count("*").alias("on_pages"))
    total = pages.groupBy("exam_id").agg(F.count("*").alias("n_pages"))
    return counts.join(total, "exam_id").filter(
        (F.col("n_pages") >= 2) & (F.col("on_pages") / F.col("n_pages") >= cfg.repeat_share)
    )


def repeated_zone_text(tagged: DataFrame, pages: DataFrame, cfg: Layout = LAYOUT) -> DataFrame:
    """B2: zone strings that are on most pages of an exam."""
    # The key depends on the zone, so that no filter on it is run on all fragments before they meet their page.
    key = F.when(F.col("zone").isNotNull(), zone_key(F.col("str")))
    keys = tagged.filter("zone is not null").select(*PAGE, key.alias("str_key"))
    return _on_most_pages(keys.dropDuplicates(), pages, cfg)


def _with_repeated(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """Pages with the page count and the repeated strings of their exam.

    Each of those strings is on most pages, so an exam has no more of them than fit on one.
    """
    total = pages.groupBy("exam_id").agg(F.count("*").alias("_n"))
    strings = repeated.groupBy("exam_id").agg(F.collect_set("str_key").alias("_strs"))
    return pages.join(total, "exam_id").join(strings, "exam_id", "left")


def _is_furniture(key: Column) -> Column:
    """Zone text that repeats, is a page number or a single character."""
    return (
        F.coalesce(F.array_contains("_strs", key), F.lit(False))
        | F.regexp_like(key, F.lit(r"^[0-9]{1,4}\z"))
        | (F.length(key) <= 1)
    )


def strip_headers_footers(tagged: DataFrame, repeated: DataFrame, pages: DataFrame) -> DataFrame:
    """Furniture in the zones goes, unless the exam has a single page.

    Repeated strings come as one short array per page, which leaves the fragments
    in their (exam, page) partitions.
    """
    per_page = _with_repeated(pages.select(*PAGE), repeated)
    return tagged.join(_by_page(per_page), PAGE, "left").filter(
        F.col("zone").isNull() | (F.coalesce("_n", F.lit(0)) < 2) | ~_is_furniture(zone_key(F.col("str")))
    ).select(*[c for c in tagged.columns if c != "zone"])


def _bucket(cfg: Layout):
    width = F.col("page_width") / cfg.buckets
    return F.least(F.floor(F.col("x") / width), F.lit(cfg.buckets - 1)).cast("int")


def x_histogram(body: DataFrame, pages: DataFrame, cfg: Layout = LAYOUT) -> DataFrame:
    """Fragments per horizontal bucket, zeros included."""
    counts = body.join(_by_page(pages.select(*PAGE, "page_width")), PAGE).groupBy(*PAGE, _bucket(cfg).alias("bucket")).agg(
        F.count("*").alias("n")
    )
    grid = pages.select(*PAGE, F.explode(F.sequence(F.lit(0), F.lit(cfg.buckets - 1))).alias("bucket"))
    return grid.join(counts, [*PAGE, "bucket"], "left").select(*PAGE, "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def _center(cfg: Layout) -> tuple[int, int]:
    return math.floor(cfg.center_margin * cfg.buckets), math.floor((1 - cfg.center_margin) * cfg.buckets)


def _split_x(per_page: DataFrame, cfg: Layout) -> DataFrame:
    """Split position from ``_n`` fragments and the counts ``_bs`` of the central buckets, null for one column.

    The central buckets become a string with ``1`` where a bucket is sparse; the
    gap is its longest run of ones, the last one on a tie.
    """
    low, high = _center(cfg)
    width = math.floor(cfg.gap_width_share * cfg.buckets)
    allowed = F.ceil(F.lit(cfg.gap_density) * F.col("_n"))
    sparse = F.array_join(F.transform("_bs", lambda n: F.when(n <= allowed, "1").otherwise("0")), "")
    best = F.array_max(F.transform(F.regexp_extract_all("_s", F.lit("1+"), 0), lambda r: F.length(r)))
    end = F.lit(high) - F.instr(F.reverse("_s"), F.repeat(F.lit("1"), F.col("_w"))) + 1
    middle = (end + end - F.col("_w") + 1) / 2
    split = F.floor(middle * (F.col("page_width") / cfg.buckets) + 0.5).cast("int")
    return (
        per_page.withColumn("_s", F.when(F.col("_n") >= cfg.min_fragments, sparse).otherwise(""))
        .withColumn("_w", F.coalesce(best, F.lit(0)))
        .withColumn("split_x", F.when(F.col("_w") >= width, split))
        .drop("_s", "_w", "_n", "_bs")
    )


def _counted(placed: DataFrame, key: list[str], cfg: Layout) -> DataFrame:
    """Fragments of each ``key`` (``_n``) and of its central buckets (``_bs``): they are counted by bucket, only these counts are spread."""
    low, high = _center(cfg)
    by_bucket = placed.groupBy(*key, _bucket(cfg).alias("_b")).agg(F.count("*").alias("_c"))
    counts = [F.coalesce(F.sum(F.when(F.col("_b") == b, F.col("_c"))), F.lit(0)) for b in range(low, high + 1)]
    return by_bucket.groupBy(*key).agg(F.sum("_c").alias("_n"), F.array(*counts).alias("_bs"))


def detect_columns(body: DataFrame, pages: DataFrame, cfg: Layout = LAYOUT) -> DataFrame:
    """Pages with a wide, sparse gap near the middle have two columns."""
    sizes = pages.select(*PAGE, "page_width")
    per_page = _counted(body.join(_by_page(sizes), PAGE), [*PAGE, "page_width"], cfg)
    found = _split_x(per_page, cfg).select(*PAGE, "split_x")
    return sizes.join(found, PAGE, "left").select(
        *PAGE, F.col("split_x").isNotNull().alias("double_column"), "split_x", "page_width"
    )


def _side():
    return F.when(F.col("split_x").isNull(), "single").when(F.col("x") < F.col("split_x"), "left").otherwise("right")


def columns_in_place(sheets: DataFrame, cfg: Layout = LAYOUT) -> DataFrame:
    """B5 and B6 on gathered pages ``(exam_id, page, page_width, _fs)``; spreads the fragments again."""
    low, high = _center(cfg)
    last = F.lit(cfg.buckets - 1)
    buckets = F.transform("_fs", lambda f: F.least(F.floor(f["x"] / (F.col("page_width") / cfg.buckets)), last).cast("int"))
    # One pass over the fragments: the sorted central buckets, of which each count is a difference of two places.
    central = F.array_sort(F.filter(buckets, lambda b: b.between(low, high)))
    counted = sheets.withColumns({"_n": F.size("_fs"), "_cs": F.array_join(F.transform(central, lambda b: F.chr(b + 1)), "")})
    counts = F.array(*[F.length("_cs") - F.length(F.translate("_cs", chr(b + 1), "")) for b in range(low, high + 1)])
    counted = counted.withColumn("_bs", counts).drop("_cs")
    return _split_x(counted, cfg).select(*PAGE, "split_x", F.inline("_fs")).withColumn("column", _side()).drop("split_x")


def assign_columns(body: DataFrame, layout: DataFrame) -> DataFrame:
    """Left, right or single."""
    return body.join(_by_page(layout.select(*PAGE, "split_x")), PAGE, "left").select(
        *body.columns,
        _side().alias("column"),
    )


def _line_numbers(stretches: Column, cfg: Layout) -> Column:
    """Ordinals of the lines of stretches ordered by place: a stretch joins the line if its gap is
    within the mean font of the line so far."""
    state = "struct<fonts: double, n: bigint, line: int, out: array<int>>"

    def step(acc: Column, f: Column) -> Column:
        far = (acc["n"] > 0) & (f["gap"] > F.greatest(acc["fonts"] / F.nullif(acc["n"], F.lit(0)) * cfg.line_y_factor, F.lit(cfg.line_y_floor)))
        line = acc["line"] + far.cast("int")
        return F.struct(
            (F.when(far, 0.0).otherwise(acc["fonts"]) + f["fonts"]).alias("fonts"), (F.when(far, 0).otherwise(acc["n"]) + f["n"]).alias("n"),
            line.alias("line"), F.concat(acc["out"], F.array(line)).alias("out"),
        ).cast(state)

    start = F.struct(F.lit(0.0).alias("fonts"), F.lit(0).alias("n"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("out")).cast(state)
    return F.aggregate(stretches, start, step)["out"]


def _stretches(columned: DataFrame, cfg: Layout) -> DataFrame:
    """Rows of fragments (``_fs``) that are on one line, with the number of the line within (page, column).

    A fragment is measured against the one above it, by the mean font of the line so far. So a gap
    up to the fixed floor never breaks a line, and one beyond the column's largest tolerance always does.
    Fragments between gaps of the first kind are a stretch with a sum of fonts; stretches between breaks
    of the second kind are a run, and only the few stretches of a run are folded. The key stays a column
    beside the gathered fragments, so the lines are built where the fragments are, without another shuffle.
    """
    key = [*PAGE, "column"]
    order = Window.partitionBy(*key).orderBy("y", "x", "str")
    gap = F.abs(F.col("y") - F.lag("y").over(order))
    widest = F.greatest(F.max("font_size").over(Window.partitionBy(*key)) * cfg.line_y_factor, F.lit(cfg.line_y_floor))
    measured = columned.select("*", gap.alias("_gap"), widest.alias("_widest"))
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(up_to)
    cut = measured.select("*", count(F.col("_gap") > cfg.line_y_floor).alias("_stretch"), count(F.col("_gap") > F.col("_widest")).alias("_run"))
    fragment = F.struct(*[c for c in columned.columns if c not in key])
    stretches = cut.groupBy(*key, "_run", "_stretch").agg(
        F.collect_list(fragment).alias("_fs"), F.sum("font_size").alias("fonts"), F.count("*").alias("n"), F.max(F.when(F.col("_gap") > cfg.line_y_floor, F.col("_gap"))).alias("gap"))
    listed = F.array_sort(F.collect_list(F.struct("_stretch", "fonts", "n", F.coalesce("gap", F.lit(0.0)).alias("gap"), "_fs")))
    runs = stretches.groupBy(*key, "_run").agg(listed.alias("_ss")).withColumn("_lines", _line_numbers(F.col("_ss"), cfg))
    before = Window.partitionBy(*key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_first", F.coalesce(F.sum(F.element_at("_lines", -1) + 1).over(before), F.lit(0)))
    rows = placed.select(*key, "_first", F.inline(F.arrays_zip(F.col("_ss")["_fs"].alias("_fs"), F.col("_lines").alias("_line"))))
    return rows.select(*key, (F.col("_first") + F.col("_line")).cast("int").alias("line_ord"), "_fs")


def group_lines(columned: DataFrame, cfg: Layout = LAYOUT) -> DataFrame:
    """Number of the text line within (page, column)."""
    return _stretches(columned, cfg).select(*PAGE, "column", "line_ord", F.inline("_fs")).select(*columned.columns, "line_ord")


def build_lines(grouped: DataFrame, cfg: Layout = LAYOUT) -> DataFrame:
    """One row per line; a gap wider than a share of the font is a space."""
    key = [*PAGE, "column", "line_ord"]
    w = Window.partitionBy(*key).orderBy("x", "y", "str")
    font = F.lag(F.when(F.col("font_size") == 0, F.lit(10.0)).otherwise(F.col("font_size"))).over(w)
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    part = F.concat(F.when(gap > font * cfg.space_factor, F.lit(" ")).otherwise(F.lit("")), F.col("str"))
    parts = grouped.select(*key, "x", "y", "str", "font_size", part.alias("_part"))
    pieces = F.array_sort(F.collect_list(F.struct("x", "y", "str", "_part")))
    return parts.groupBy(*key).agg(
        trimmed(F.array_join(F.transform(pieces, lambda p: p["_part"]), "")).alias("text"),
        F.min(F.struct("x", "y", "str")).alias("_left"),
        F.max("font_size").alias("font_size"),
    ).select(*key, "text", F.col("_left")["y"].alias("line_y"), F.col("_left")["x"].alias("line_x"), "font_size")


def _line_starts(fs: Column, gaps: Column, start: Column, end: Column, cfg: Layout) -> Column:
    """Places from ``start`` to before ``end`` of a run at which a line begins: fragments between gaps up to the fixed
    floor are summed, a larger gap is measured against the mean font of the line so far."""
    state = "struct<fonts: double, n: bigint, of: double, at: bigint, out: array<int>>"

    def step(acc: Column, i: Column) -> Column:
        font, gap = F.get(fs, i)["font_size"], F.get(gaps, i)
        apart = (i > start) & F.coalesce(gap > cfg.line_y_floor, F.lit(False))
        total, n = acc["fonts"] + acc["of"], acc["n"] + acc["at"]
        far = apart & (gap > F.greatest(total / F.nullif(n, F.lit(0)) * cfg.line_y_factor, F.lit(cfg.line_y_floor)))
        return F.struct(
            F.when(far, 0.0).when(apart, total).otherwise(acc["fonts"]).alias("fonts"), F.when(far, 0).when(apart, n).otherwise(acc["n"]).alias("n"),
            F.when(apart, font).otherwise(F.coalesce(acc["of"] + font, acc["of"], font)).alias("of"), F.when(apart, 1).otherwise(acc["at"] + 1).alias("at"),
            F.when(far, F.concat(acc["out"], F.array(i))).otherwise(acc["out"]).alias("out"),
        ).cast(state)

    first = F.struct(F.lit(0.0).alias("fonts"), F.lit(0).alias("n"), F.lit(None).alias("of"), F.lit(0).alias("at"), F.array(start).alias("out")).cast(state)
    return F.aggregate(F.sequence(start, end - 1), first, step)["out"]


def lines_in_place(columned: DataFrame, cfg: Layout = LAYOUT) -> DataFrame:
    """B7 and B8 composed, by the rule of ``group_lines``: a column of a page is gathered and cut into lines, and
    the fragments of a line are put in order and joined where they are."""
    key = [*PAGE, "column"]
    at = lambda name, i: F.get(F.col(name), i)
    # What a function of each fragment looks at is a column of its own: an expression would be evaluated for each fragment again.
    gathered = columned.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("y", "x", "str", "width", "font_size"))).alias("_fs"), F.max("font_size").alias("_font"))
    gaps = F.transform("_fs", lambda f, i: F.abs(f["y"] - at("_fs", i - 1)["y"]))
    widest = F.greatest(F.col("_font") * cfg.line_y_factor, F.lit(cfg.line_y_floor))
    measured = gathered.select(*key, "_fs", gaps.alias("_gaps"), widest.alias("_widest"), F.size("_fs").alias("_size"))
    # Runs begin behind a gap that always breaks a line. Where no gap of a run is above the floor, it is one line.
    far = lambda i: (i == 0) | F.coalesce(at("_gaps", i) > F.col("_widest"), F.lit(False))
    runs = measured.withColumn("_runs", F.filter(F.sequence(F.lit(0), F.col("_size") - 1), far))

    def lines_of(start: Column, k: Column) -> Column:
        end = F.coalesce(at("_runs", k + 1), F.col("_size"))
        one = ~F.exists(F.slice("_gaps", start + 2, end - start - 1), lambda g: F.coalesce(g > cfg.line_y_floor, F.lit(False)))
        return F.when(one, F.array(start)).otherwise(_line_starts(F.col("_fs"), F.col("_gaps"), start, end, cfg))

    cut = runs.select(*key, "_fs", "_size", F.flatten(F.transform("_runs", lines_of)).alias("_lines"))
    of_line = F.transform("_lines", lambda a, k: F.slice("_fs", a + 1, F.coalesce(at("_lines", k + 1), F.col("_size")) - a))
    lines = cut.select(*key, F.posexplode(of_line).alias("line_ord", "_line"))
    across = F.sort_array(F.transform("_line", lambda f: F.struct(f["x"], f["y"], f["str"], f["width"], f["font_size"])))
    placed = lines.select(*key, "line_ord", F.explode(F.array(across)).alias("_fs"))  # put in order once, used several times

    def part(f: Column, i: Column) -> Column:
        last = at("_fs", i - 1)
        font = F.when(last["font_size"] == 0, F.lit(10.0)).otherwise(last["font_size"])
        gap = f["x"] - (last["x"] + last["width"])
        return F.concat(F.when(gap > font * cfg.space_factor, F.lit(" ")).otherwise(F.lit("")), f["str"])

    first = F.col("_fs")[0]
    return placed.select(
        *key, "line_ord", trimmed(F.array_join(F.transform("_fs", part), "")).alias("text"),
        first["y"].alias("line_y"), first["x"].alias("line_x"), F.array_max(F.col("_fs")["font_size"]).alias("font_size"))


def reading_order(lines: DataFrame) -> DataFrame:
    """Line numbers over the exam: pages, then left before right, then top to bottom."""
    rank = F.when(F.col("column") == "right", 1).otherwise(0)
    return position(lines, ["exam_id"], F.col("page"), [rank, F.col("line_y"), F.col("line_ord")], "line_no")


def page_lines(fragments: DataFrame, pages: DataFrame, cfg: Layout = LAYOUT) -> DataFrame:
    """B1 to B8 composed: the lines of every page, not yet numbered over the exam.

    Only what lines are made of goes along. A page that is there twice is read twice, each time by its own sizes (``_p``).
    """
    placed = fragments.filter("exam_id is not null and page is not null").select(*PAGE, "x", "y", "str", "width", "font_size")
    order = Window.partitionBy(*PAGE).orderBy("page_height", "page_width")
    sizes = pages.select(*PAGE, "page_height", "page_width").withColumn("_p", F.row_number().over(order))
    rel = F.col("y") / F.col("page_height")
    in_zone = F.coalesce((rel < cfg.header_zone) | (rel > 1 - cfg.footer_zone), F.lit(False))
    # The key depends on the zone, so that no filter on it is run on all fragments before they meet their page.
    key = F.when(in_zone, zone_key(F.col("str")))
    zoned = placed.join(_by_page(sizes), PAGE).filter(in_zone).select(*PAGE, "_p", key.alias("str_key"))
    known = _with_repeated(sizes, _on_most_pages(zoned.distinct(), pages, cfg))
    body = placed.join(_by_page(known), PAGE, "left").filter(
        ~in_zone | (F.coalesce("_n", F.lit(0)) < 2) | ~_is_furniture(zone_key(F.col("str")))).drop("_n", "_strs")
    found = _split_x(_counted(body.filter("_p is not null"), [*PAGE, "_p", "page_width"], cfg), cfg)
    splits = found.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("_p", "split_x"))).alias("_splits"))
    split_x = F.element_at("_splits", F.col("_p"))
    columned = body.join(_by_page(splits), PAGE, "left").withColumn("split_x", split_x).withColumn("column", _side())
    return lines_in_place(columned, cfg)


def reconstruct_layout(fragments: DataFrame, pages: DataFrame, cfg: Layout = LAYOUT) -> DataFrame:
    """B1 to B9 composed. The lines are written once and by page, being read for counts and for rows."""
    return reading_order(materialize(page_lines(fragments, pages, cfg), "lines", PAGE))
