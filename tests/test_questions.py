"""Question parser: quirks of both readings on small hand-written exams."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from examlens.config import PARSER
from examlens.operators import questions as q
from examlens.registry.fixtures import view
from examlens.registry.questions import QUERIES

STEM = "Qual das alternativas abaixo descreve melhor o que foi pedido aqui?"
GOOD = ["(A) uma coisa bem dita", "(B) outra coisa bem dita", "(C) mais uma coisa dita", "(D) ainda outra coisa dita", "(E) por fim coisa dita"]


def question(n, stem=STEM, options=GOOD):
    return [f"{n}. {stem}", *options]


def lines(spark, *exams):
    rows = [(e, 1, i, t) for e, ls in enumerate(exams) for i, t in enumerate(ls)]
    return spark.createDataFrame(rows, "exam_id bigint, page int, line_no int, text string")


def pages(spark, images=()):
    return spark.createDataFrame([(0, 1, 595.0, 842.0, 0 in images)], "exam_id bigint, page int, page_width double, page_height double, has_images boolean")


def parse(spark, ls, **kw):
    return {r.num: r for r in q.parse_questions(lines(spark, ls), kw.get("pages")).orderBy("num").collect()}


def scan(spark, *exams, cfg=PARSER, allow_reset=True):
    return q.scan_numbers(q.number_spans(q.classify_lines(q.strip_scratch(lines(spark, *exams))), None, cfg), allow_reset, cfg)


def test_scores(spark):
    got = parse(spark, [*question(1), *question(2, options=GOOD[:3])])
    assert got[1].score == 100 and got[1].details == []
    assert got[2].score == 30 + 45 - 20
    assert got[2].details == ["alternativa D vazia", "alternativa E vazia"]


def test_scratch_and_continuation(spark):
    ls = ["1. Qual das alternativas abaixo descreve melhor", "o que foi pedido? rascunho xyz", "RASCUNHO", *GOOD[:4], GOOD[4], "com continuação"]
    got = parse(spark, ls)
    assert got[1].text.endswith("o que foi pedido?") and got[1].e == "por fim coisa dita com continuação"


def test_white_space_before_a_scratch_mark_goes(spark):
    got = q.strip_scratch(lines(spark, ["texto \u00a0\t RASCUNHO"])).collect()
    assert [r.text for r in got] == ["texto"]


def test_bare_number(spark):
    assert parse(spark, ["7", STEM, *GOOD])[7].text == STEM
    assert parse(spark, ["7", "8. " + STEM, *GOOD])[7].text == "8. " + STEM  # the line after a bare number is its text
    assert parse(spark, [*question(1), "2", *GOOD])[1].score == 100  # an option cannot begin a question
    got = parse(spark, [*question(1), "2", "3", STEM, *GOOD])
    assert list(got) == [1, 3] and got[1].e == "por fim coisa dita"


def test_first_number_and_jump(spark):
    assert parse(spark, question(21)) == {}
    assert list(parse(spark, [*question(1), *question(6), *question(12)])) == [1, 6]


def test_rejected_start_is_body(spark):
    got = parse(spark, ["1. " + STEM, "50. fora de ordem", *GOOD])
    assert got[1].text.endswith("50. fora de ordem")
    got = parse(spark, [*question(1), "50. fora", "50"])
    assert got[1].e == "por fim coisa dita 50. fora"


def test_short_stem_on_image_page(spark):
    ls = question(1, stem="Observe a figura e responda já.")
    got = parse(spark, ls, pages=pages(spark, images=(0,)))
    assert got[1].requires_source and got[1].score == 75 + 10 - 20


def test_instructions_without_options_lose_no_question(spark):
    """A number counts against the last confirmed question, not the last one that was read."""
    cover = [f"{n:02d} - Leia com muita atencao as instrucoes desta capa." for n in range(1, 11)]
    got = parse(spark, [*cover, *[x for n in range(1, 13) for x in question(n)]])
    assert list(got) == list(range(1, 13)) and got[10].text == STEM
    got = parse(spark, ["15. Nao e permitido o uso de aparelhos eletronicos.", *[x for n in range(1, 17) for x in question(n)]])
    assert list(got) == list(range(1, 17))
    assert list(parse(spark, [*cover[:4], *[x for n in range(1, 7) for x in question(n)]])) == [1, 2, 3, 4, 5, 6]


def test_weak_lead_block(spark):
    lead = [x for n in range(1, 6) for x in question(n, options=GOOD[:3])]
    ls = [*lead, *question(1, stem="Real? " + STEM), *question(2)]
    got = parse(spark, ls)
    assert list(got) == [1, 2] and got[1].text.startswith("Real?")
    items = q.drop_weak_lead_block(scan(spark, ls)).orderBy("line").collect()
    assert [(r.num, r.rolled_back) for r in items] == [(1, True), (2, True), (3, True), (4, True), (5, True), (1, False), (2, False)]


def test_strong_block_keeps_its_numbers(spark):
    strong = [x for n in range(1, 6) for x in question(n)]
    got = parse(spark, [*strong, *question(1, stem="Outra? " + STEM), *question(6)])
    assert list(got) == [1, 2, 3, 4, 5, 6] and not got[1].text.startswith("Outra?")


def test_four_weak_items_are_not_enough(spark):
    """The fourth is still open when the restart comes, so three are confirmed."""
    lead = [x for n in range(1, 5) for x in question(n, options=GOOD[:3])]
    assert list(parse(spark, [*lead, *question(1)])) == [1, 2, 3, 4]


def test_shared_text(spark):
    ls = ["Leia o texto para responder às questões 1 a 2", "Era uma vez.", *question(1), *question(2), *question(3)]
    got = parse(spark, ls)
    assert got[1].shared_id == got[2].shared_id == "shared-1-2" and got[3].shared_id is None
    assert got[1].context_text.endswith("Era uma vez.")
    assert parse(spark, ["Considere o texto.", "Use nas questões 1 a 1.", *question(1)])[1].shared_id == "shared-1-1"
    assert parse(spark, ["Leia o texto.", *question(1)])[1].shared_id is None


def test_repeated_marker_replaces(spark):
    got = parse(spark, ["1. " + STEM, *GOOD, "(B) de novo dita aqui"])
    assert got[1].b == "de novo dita aqui"


def test_first_of_several_options_on_a_line_is_continued(spark):
    got = parse(spark, ["1. " + STEM, "(A) um dois três (B) quatro cinco seis", "segue", *GOOD[2:]])[1]
    assert (got.a, got.b) == ("um dois três segue", "quatro cinco seis")


def test_repeated_number_is_accepted_once(spark):
    """The gate compares with the last confirmed question, which is one behind."""
    ls = [*question(1), *question(2), *question(2, stem="Outra? " + STEM), *question(3)]
    assert [r.num for r in q.parse_questions(lines(spark, ls)).orderBy("num").collect()] == [1, 2, 2, 3]


def test_lead_text_without_range_is_kept(spark):
    c = q.classify_lines(lines(spark, ["capa", "Leia o texto.", "Corpo.", *question(1)]))
    row = q.shared_texts(q.assemble_questions(q.segment_questions(c, q.scan_numbers(q.number_spans(c))))).collect()
    assert [(r.shared_id, r.text, r.first) for r in row] == [("shared-pre-1", "Leia o texto. Corpo.", None)]


def test_option_lines_before_any_question_are_ignored(spark):
    assert parse(spark, ["(A) nada", *question(1)])[1].a == "uma coisa bem dita"


def test_blocks_do_not_change_the_result(spark, sf_dir):
    ls, pg = view(spark, sf_dir, "fx_lines_x"), view(spark, sf_dir, "fx_pages")
    rows = lambda cfg: sorted(map(repr, q.parse_questions(ls, pg, cfg).collect()))
    assert rows(replace(PARSER, block_lines=997)) == rows(PARSER)


def test_one_exam_of_many_blocks(spark):
    """Open question and option carry over block borders."""
    ls = [x for n in range(1, 60) for x in question(n)]
    one = q.parse_questions(lines(spark, ls), cfg=replace(PARSER, block_lines=4)).orderBy("num").collect()
    assert [r.num for r in one] == list(range(1, 60)) and {r.score for r in one} == {100}


def test_gate_against_a_plain_loop(spark):
    """Random numbers, half of them with options; a plain machine over whole questions says what is accepted."""
    rnd = random.Random(5)
    exams = [[(rnd.choice([1, 1, 2, 3, 4, 5, 6, 7, 8, 12, 21, 40]), rnd.choice([0, 3, 5])) for _ in range(40)] for _ in range(30)]

    def gate(items):
        last, run, first, n, opened, ok = None, [], False, 0, None, []
        for num, options in items:
            fwd = num <= 20 if last is None else 0 < num - last <= 5
            weak = len(run) >= 4 and first and sum(min(o, 5) for _, o in run) / len(run) <= 3
            reset = not fwd and last is not None and num == 1 and weak
            forced = reset and opened and run[0][0] <= opened[0] <= run[-1][0] + 1
            if reset:
                last, run, n = None, [], 0
            ok.append(fwd or reset)
            if ok[-1]:
                if opened and opened[1] and not forced:
                    follows = run and opened[0] == run[-1][0] + 1
                    first = first if follows else n == 0
                    run = [*run, opened] if follows else [opened]
                    last, n = opened[0], n + 1
                opened = (num, options)
            elif opened and options:
                opened = (opened[0], max(opened[1], options))
        return ok

    texts = [[x for num, options in items for x in question(num, options=GOOD[:options])] for items in exams]
    starts = [[i for i, t in enumerate(ls) if not t.startswith("(")] for ls in texts]
    want = {(e, i): v for e, items in enumerate(exams) for i, v in zip(starts[e], gate(items), strict=True)}
    got = scan(spark, *texts).seen.collect()
    assert {(r.exam_id, r.line_no): r.accepted for r in got} == want


def test_items_by_block_are_not_broadcast(spark):
    """With sparse line numbers the rows of items by block are far more than the items."""
    ls = [t for n in range(1, 4) for t in question(n)]
    df = lines(spark, ls, ls).withColumn("line_no", F.col("line_no") * 100000)
    classified = q.classify_lines(q.strip_scratch(df))
    got = q.segment_questions(classified, q.scan_numbers(q.number_spans(classified)))
    assert len(got.collect()) == 2 * len(ls)
    joins = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x and "_block" in x]
    assert joins and not any("Broadcast" in x for x in joins)


def test_growing_tables_are_not_broadcast(spark, tmp_path):
    """Pages and numbered lines come from files whose compressed bytes look small."""
    ls = [t for n in range(1, 4) for t in question(n)]
    spark.createDataFrame([(0, 1, True), (1, 1, False)], "exam_id long, page int, has_images boolean").write.parquet(f"{tmp_path}/pages")
    pg = spark.read.parquet(f"{tmp_path}/pages")
    classified = q.classify_lines(q.strip_scratch(lines(spark, ls, ls)))
    spans = q.number_spans(classified, pg)
    segments = q.segment_questions(classified, q.scan_numbers(spans))
    flagged = q.flag_requires_source(q.assemble_questions(segments).filter("num >= 0"), pg)
    assert len(flagged.collect()) == 6
    for df, column in ((spans, "_img"), (segments, "_skips"), (flagged, "_img")):
        joins = [x for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in x]
        assert joins and df._jdf.queryExecution().sparkPlan().toString().count(column)
        assert not any("BroadcastHashJoin" in x and ("page" in x or "item_line" in x) for x in joins)


def test_rows_of_one_exam_each_are_not_broadcast(spark):
    """First lines, last lines, resets and shared texts are as many as exams; their files look small."""
    ls = ["Leia o texto a seguir para responder as questoes 1 a 2", "Um texto base.", *[t for n in range(1, 4) for t in question(n)]]
    classified = q.classify_lines(q.strip_scratch(lines(spark, ls, ls)))
    found = q.scan_numbers(q.number_spans(classified))
    assembled = q.assemble_questions(q.segment_questions(classified, found))
    attached = q.attach_shared_text(assembled.filter("num >= 0"), q.shared_texts(assembled))
    assert sorted((r.exam_id, r.num, r.shared_id) for r in attached.collect()) == [(e, n, "shared-1-2" if n < 3 else None) for e in (0, 1) for n in (1, 2, 3)]
    for df in (found.items, assembled, attached):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_items_and_shared_texts_are_assembled_once(spark, tmp_path):
    """The query reads items and texts from one assembly: no line is classified, shuffled and gathered for each of them."""
    spark.range(20).selectExpr("id doc_id", "repeat('uma palavra ', 20) text").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["attach_shared_text"](spark, str(tmp_path))
    assert {(r.exam_id, r.num) for r in got.collect() if r.shared_id == "shared-1-3"} == {(0, 1), (0, 2), (0, 3)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("Relation") == 2


def test_plain_searches_stand_before_the_patterns(spark):
    """Most lines have no mark: no pattern is run on them, and lines that pass the search are read as before."""
    texts = ["abc 1. x", "\u00a07. x", "\u30009", "Rascunho", "a rascunhO b", "rascunhos", "QUEST\u00d5ES 1 a 3", "que\u017ftoes 2 e 4", "quest 1 a 2", " (B) x", "\u00c9 (B)", "z (B) x", "", None]
    got = {r.line_no: (r.kind, r.text) for r in q.classify_lines(q.strip_scratch(lines(spark, texts))).collect()}
    kinds = ["body", "start", "alone", None, "body", "body", "range", "range", "body", "option", "body", "body", None, None]
    assert [got.get(i, (None,))[0] for i in range(len(texts))] == kinds and got[4][1] == "a"
    plan = q.split_inline_options(q.classify_lines(q.strip_scratch(lines(spark, texts))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?is)(?<!") == 3 * plan.count("RASCUNHO) THEN CASE WHEN (regexp_replace") > 0


def test_log_reads_its_numbers_once(spark, tmp_path, monkeypatch):
    """All events of the log come from one scan of lines that were labelled once, stored where they meet their items."""
    docs = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(60)), "en", "web", 600) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    calls = []
    for name in ("scan_numbers", "classify_lines"):
        monkeypatch.setattr(q, name, lambda *a, f=getattr(q, name), n=name, **k: calls.append(n) or f(*a, **k))
    got = QUERIES["parsing_log"](spark, str(tmp_path))
    assert sorted(calls) == ["classify_lines", "scan_numbers"]
    files = got.inputFiles()
    assert any("classified-" in f for f in files) and not any("fx_lines_x" in f for f in files)
    assert {r.event for r in got.collect()} >= {"total", "real_question_confirmed", "shared_text"}
