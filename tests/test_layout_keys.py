"""Layout, answer keys and the ordered helpers on small inputs."""

import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from examlens.functions.ordered import carry_forward, position, running_sum
from examlens.operators import keys as k
from examlens.operators import layout as y
from examlens.registry import layout as rl
from examlens.registry.fixtures import view
from examlens.sources.sinks import materialize

FRAG = "exam_id bigint, page int, str string, x double, y double, width double, font_size double"
PAGES = "exam_id bigint, page int, page_width double, page_height double, has_images boolean"


def page(spark, n=1):
    return spark.createDataFrame([(0, p, 100.0, 800.0, False) for p in range(1, n + 1)], PAGES)


def test_widest_gap_last_on_a_tie(spark):
    """Sparse buckets 30-39 and 61-70, dense 40-60: both gaps are ten wide."""
    rows = [(0, 1, f"t{b}{i}", b + 0.5, 100.0 + i, 1.0, 10.0) for b in range(40, 61) for i in range(5)]
    got = y.detect_columns(spark.createDataFrame(rows, FRAG), page(spark)).collect()[0]
    assert got.double_column and got.split_x == 66  # middle of 61..70, rounded up


def test_clipped_rows_are_not_sorted(spark):
    """Rows meet their page by hash; repeated and null rows stay what they are."""
    rows = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 2, "b"), (0, 3, "c"), (1, 1, "d"), (2, 1, "e"), (None, 1, "f"), (0, None, "g")], "exam_id bigint, page int, str string")
    pages = spark.createDataFrame([(0, 1), (0, 2), (0, 2), (0, 3), (1, 1), (None, 1), (0, None)], "exam_id bigint, page int")
    got = y.clip_page_range(rows, pages, spark.createDataFrame([(0, 2, 2)], "exam_id bigint, page_start int, page_end int"))
    assert sorted(r.str for r in got.collect()) == ["b", "b", "d"]
    assert "ShuffledHashJoin" in got._jdf.queryExecution().sparkPlan().toString()


def test_fragments_read_once_are_not_written(spark, tmp_path):
    """The clip is the only reader of its fragments: they are part of its plan, unless an earlier query left them as a table."""
    docs = [(i, " ".join(f"w{n}" for n in range(40)), "en", "web", 100) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    clipped = rl.QUERIES["clip_page_range"](spark, str(tmp_path))
    assert not any("fx_fragments" in f for f in clipped.inputFiles())
    rows = sorted(clipped.collect())
    view(spark, str(tmp_path), "fx_fragments")
    again = rl.QUERIES["clip_page_range"](spark, str(tmp_path))
    assert any("fx_fragments" in f for f in again.inputFiles()) and sorted(again.collect()) == rows and rows


def test_few_fragments_are_one_column(spark):
    rows = [(0, 1, str(i), float(i), 100.0, 1.0, 10.0) for i in range(9)]
    assert not y.detect_columns(spark.createDataFrame(rows, FRAG), page(spark)).collect()[0].double_column


def test_in_place_columns_agree(spark):
    rnd = random.Random(1)
    rows = [(0, p, str(i), rnd.random() * (100 if p % 2 else 40) + (60 if i % 3 == 0 else 0) * (p % 2 == 0), 100.0 + i, 1.0, 10.0)
            for p in range(1, 9) for i in range(60)]
    df, pg = spark.createDataFrame(rows, FRAG), page(spark, 8)
    apart = y.assign_columns(df, y.detect_columns(df, pg))
    sheets = df.groupBy("exam_id", "page").agg(F.collect_list(F.struct("str", "x", "y", "width", "font_size")).alias("_fs"))
    inplace = y.columns_in_place(sheets.join(pg.select("exam_id", "page", "page_width"), ["exam_id", "page"]))
    assert sorted(apart.collect()) == sorted(inplace.select(*apart.columns).collect())


def test_headers_stay_on_a_single_page(spark):
    rows = [(0, 1, "HEAD", 10.0, 10.0, 5.0, 10.0), (0, 1, "3", 10.0, 790.0, 5.0, 10.0)]
    df = spark.createDataFrame(rows, FRAG)
    for n, kept in ((1, 2), (2, 1)):  # on two pages HEAD is on half of them, the number goes
        t = y.tag_zones(df, page(spark, n))
        assert y.strip_headers_footers(t, y.repeated_zone_text(t, page(spark, n)), page(spark, n)).count() == kept


def test_space_threshold_and_line_tolerance(spark):
    rows = [(0, 1, "a", 0.0, 100.0, 5.0, 10.0), (0, 1, "b", 8.0, 100.0, 5.0, 10.0), (0, 1, "c", 16.1, 100.0, 5.0, 10.0)]
    df = spark.createDataFrame(rows, FRAG).withColumn("column", F.lit("single"))
    assert [r.text for r in y.build_lines(y.group_lines(df)).collect()] == ["ab c"]
    # A small font after large ones: the mean of the line is more tolerant than the last font.
    rows = [(0, 1, "a", 0.0, 100.0, 5.0, 20.0), (0, 1, "b", 9.0, 101.0, 5.0, 6.0), (0, 1, "c", 20.0, 106.0, 5.0, 6.0)]
    df = spark.createDataFrame(rows, FRAG).withColumn("column", F.lit("single"))
    assert y.group_lines(df).agg(F.max("line_ord")).collect()[0][0] == 0


def key_lines(spark, *texts):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "exam_id bigint, line_no int, text string")


def keys(spark, wanted, *texts, block=4096):
    ex = spark.createDataFrame([(0, wanted)], "exam_id bigint, booklet string")
    return {r.q_order: r.answer for r in k.parse_answer_keys(key_lines(spark, *texts), ex, block).collect()}


def test_pair_shapes_and_neighbours(spark):
    assert keys(spark, None, "1-A 2 B 3) c,4d;5:E 6.A 7–B") == {1: "A", 2: "B", 3: "C", 4: "D", 5: "E", 6: "A", 7: "B"}
    assert keys(spark, None, "1 AB 2-F x3A 201-A 0-A") == {}


def test_pattern_order_and_first_wins(spark):
    assert keys(spark, None, "2A 2-B", "2-C") == {2: "B"}


def test_header_line_may_hold_a_pair(spark):
    assert keys(spark, None, "GABARITO 1 - A", "2-B") == {1: "A", 2: "B"}


def test_sections(spark):
    text = ["9-E", "GABARITO 1 - PROVA A", "1-A", "GABARITO 2 - PROVA B", "1-B", "2-B"]
    for block in (1, 2, 4096):
        assert keys(spark, " a ", *text, block=block) == {1: "A"}
        assert keys(spark, "B", *text, block=block) == {1: "B", 2: "B"}
        assert keys(spark, "C", *text, block=block) == {1: "B", 2: "B"}  # not there: best covered
        assert keys(spark, None, *text, block=block) == {1: "B", 2: "B"}
    assert keys(spark, "A", "PROVA A", "GABARITO PROVA B", "1-B") == {}  # the wanted booklet is empty
    assert keys(spark, None, "GABARITO", "1-A", "GABARITO", "2-B") == {1: "A", 2: "B"}  # merged


def test_annulments(spark):
    got = keys(spark, None, "1-A", "2-*", "3-C", "Questão 3 ANULADA", "3-C")
    assert got == {1: "A"}


def test_ordered_helpers_against_windows(spark):
    rnd = random.Random(3)
    rows = [(g, i, rnd.choice([None, 1, 2, 3])) for g in range(3) for i in sorted(rnd.sample(range(500), 120))]
    df = spark.createDataFrame(rows, "g int, i int, v int")
    w = Window.partitionBy("g").orderBy("i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "g", "i", F.last("v", True).over(upto).alias("c"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("s"),
        F.row_number().over(w).alias("n"), F.min(F.when(F.col("v") == 3, F.col("i"))).over(Window.partitionBy("g")).alias("f"))
    for block in (1, 16, 1000):
        at = F.floor(F.col("i") / block)
        got = carry_forward(df, ["g"], "i", {"c": F.col("v")}, block, {"f": F.when(F.col("v") == 3, F.col("i"))})
        got = running_sum(got, ["g"], at, [F.col("i")], F.col("v"), "s")
        got = position(got, ["g"], at, [F.col("i")], "n")
        assert sorted(got.select("g", "i", "c", "s", "n", "f").collect()) == sorted(want.collect())


def test_line_grouping_against_a_plain_loop(spark):
    rnd = random.Random(8)
    rows = [(e, p, f"s{i}", rnd.uniform(0, 500), rnd.uniform(0, 90), 5.0, rnd.choice([0.0, 4.0, 10.0, 30.0])) for e in range(2) for p in range(2) for i in range(40)]
    want = {}
    for e in range(2):
        for p in range(2):
            line, fonts, last = 0, [], None
            for r in sorted((r for r in rows if r[:2] == (e, p)), key=lambda r: (r[4], r[3], r[2])):
                if fonts and abs(r[4] - last) > max(0.55 * sum(fonts) / len(fonts), 3):
                    line, fonts = line + 1, []
                fonts.append(r[6])
                last = want[(e, p, r[2])] = r[4]
                want[(e, p, r[2])] = line
    got = y.group_lines(spark.createDataFrame(rows, FRAG).withColumn("column", F.lit("single"))).collect()
    assert {(r.exam_id, r.page, r.str): r.line_ord for r in got} == want


def test_line_grouping_by_stretches_and_runs(spark):
    """Gaps below the floor, between floor and largest tolerance, and above it; fonts of several sizes."""
    from examlens.config import LAYOUT

    rng = random.Random(3)
    for steps in ((0, 1, 2, 3, 4, 5, 8), (0, 12), (0, 3, 6)):
        fs, at = [], 0.0
        for i in range(300):
            at += rng.choice(steps)
            fs.append((at, float(rng.randint(0, 50)), f"s{i}", float(rng.choice([6, 10, 20]))))
        want, last, fonts, n, line = [], 0.0, 0.0, 0, 0
        for f in sorted(fs):
            if n and abs(f[0] - last) > max(fonts / n * LAYOUT.line_y_factor, LAYOUT.line_y_floor):
                line, fonts, n = line + 1, 0.0, 0
            last, fonts, n = f[0], fonts + f[3], n + 1
            want.append((*f, line))
        df = spark.createDataFrame([(1, 1, *f, "single") for f in fs], "exam_id long, page int, y double, x double, str string, font_size double, column string")
        assert sorted((r.y, r.x, r.str, r.font_size, r.line_ord) for r in y.group_lines(df).collect()) == sorted(want)


def test_lines_are_built_where_fragments_are(spark):
    """From columned fragments to lines there is one shuffle, and every fragment is on its line."""
    rows = [(e, 1, f"t{i:02d}", 10.0 * (i % 4), 100.0 + 4 * (i // 4) + 8 * (i // 8), 5.0, 10.0) for e in range(3) for i in range(24)]
    df = spark.createDataFrame(rows, FRAG).withColumn("column", F.lit("single"))
    got = y.build_lines(y.group_lines(df))
    found = got.collect()
    # Gaps of 4 stay on the line (0.55 x 10 = 5.5), gaps of 12 break it.
    assert sorted((r.exam_id, r.line_ord) for r in found) == [(e, k) for e in range(3) for k in range(3)]
    assert all(sorted(re.findall("t[0-9]{2}", r.text)) == [f"t{8 * r.line_ord + i:02d}" for i in range(8)] for r in found)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_zone_keys_are_made_of_zone_text_only(spark):
    """No filter on the key runs on fragments that have not met their page."""
    rows = [(0, p, "  HEAD ", 10.0, 10.0, 5.0, 10.0) for p in (1, 2)] + [(0, 1, "body", 10.0, 400.0, 5.0, 10.0)]
    pg = page(spark, 2)
    got = y.repeated_zone_text(y.tag_zones(spark.createDataFrame(rows, FRAG), pg), pg)
    assert [(r.str_key, r.on_pages, r.n_pages) for r in got.collect()] == [("head", 2, 2)]
    filters = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x and "regexp_replace" in x]
    assert all("page_height" in x for x in filters)


def test_written_once_small_and_narrow(spark):
    """Lines come from the columns they are made of; what is written between is compressed by zstd."""
    df = spark.createDataFrame([(0, 1, "a", 10.0, 400.0, 5.0, 10.0)], FRAG).withColumn("note", F.concat(F.lit("n"), "str"))
    made = y.page_lines(df, page(spark))
    assert "note" not in made._jdf.queryExecution().optimizedPlan().toString()
    written = materialize(made, "test")
    assert [r.text for r in written.collect()] == ["a"]
    assert all(f.endswith(".zstd.parquet") for f in written.inputFiles())


def documents(spark, path, n=40):
    """A folder with a documents table whose exams have several pages."""
    docs = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(150)), "en", "web", 600) for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_fragments_stored_by_page_are_not_shuffled(spark, tmp_path):
    """Each use of the stored fragments reads its buckets; what is shuffled are tables of pages, and no join sorts fragments."""
    d = documents(spark, tmp_path)
    for name in ("assign_columns", "group_lines", "group_lines_exact", "build_lines"):
        got = rl.QUERIES[name](spark, d)
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "ShuffledHashJoin" in plan
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        scans = [x for x in plan.split("\n") if "FileScan" in x and "fx_fragments" in x]
        assert scans and all("Bucketed: true" in x for x in scans)
        shuffled = [a for a, b in zip(plan.split("\n"), plan.split("\n")[1:]) if "Exchange" in a and " str#" in b.split("FileScan")[0]]
        assert not shuffled


def test_lines_are_built_once_for_their_order(spark, tmp_path):
    got = rl.QUERIES["reading_order"](spark, documents(spark, tmp_path))
    files = got.inputFiles()
    assert files and all("built-" in f for f in files)
    assert [r.line_no for r in got.filter("exam_id = 1").orderBy("line_no").collect()] == list(range(1, got.filter("exam_id = 1").count() + 1))


def test_stored_by_buckets(spark):
    """Repeated and null keys stay; what works by the key needs no shuffle; no table is left in the catalog, the setting is as before."""
    rows = [(i % 5 or None, i % 3, f"r{i // 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "exam_id long, page int, str string")
    kept = {t.name for t in spark.catalog.listTables()}
    got = materialize(df, "test", ["exam_id", "page"], 2)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    plan = got.groupBy("exam_id", "page").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SelectedBucketsCount: 8 out of 8" in plan
    assert {t.name for t in spark.catalog.listTables()} == kept
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == "0"


def test_lines_in_place_agree(spark):
    """Lines of gathered columns are those of B7 and B8, with gaps of all kinds and null values; nothing is looked up by an expression over the column."""
    rnd = random.Random(4)
    some = lambda v: None if rnd.random() < 0.04 else v
    rows = []
    for e, steps in enumerate(((0, 1, 2, 3, 4, 5, 8), (0, 12), (0, 3, 6))):
        at = 0.0
        for i in range(200):
            at += rnd.choice(steps)
            rows.append((e, 1, f"s{i}", some(float(rnd.randint(0, 50))), some(at), some(5.0), some(rnd.choice([0.0, 6.0, 7.3, 10.0, 20.0]))))
    df = spark.createDataFrame(rows, FRAG).withColumn("column", F.lit("single"))
    inplace = y.lines_in_place(df)
    assert sorted(map(str, inplace.collect())) == sorted(map(str, y.build_lines(y.group_lines(df)).collect()))
    plan = inplace._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "Window" not in plan


def test_a_page_that_is_there_twice(spark):
    """Its fragments come twice, each time by the sizes of that row; a page without sizes keeps its fragments."""
    rows = [(0, p, f"t{p}", 10.0, 400.0, 5.0, 10.0) for p in (1, 2)]
    pages = spark.createDataFrame([(0, 1, 100.0, 800.0, False), (0, 1, 200.0, 500.0, False)], PAGES)
    got = y.page_lines(spark.createDataFrame(rows, FRAG), pages).collect()
    assert sorted((r.page, r.text) for r in got) == [(1, "t1t1"), (2, "t2")]
