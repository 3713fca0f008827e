"""Enrichment, lifecycle, quiz, classification, text tier and table writes on small inputs."""

import datetime
import hashlib
import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from examlens.config import CLASSIFICATION, PAGE_SEPARATOR
from examlens.functions import text as t
from examlens.operators import classify as c
from examlens.operators import enrich as e
from examlens.operators import lifecycle as lc
from examlens.operators import quality as ql
from examlens.operators import quiz as z
from examlens.operators import texttier as x
from examlens.sources import readers, sinks


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).collect()[0][0]


@pytest.mark.parametrize("raw,want", [("a", "A"), (" e ", "E"), ("C) opt", "C"), ("b:", "B"), ("d-", "D"), ("a x", "A"), ("AB", None), ("X", None), ("", None), (" b ", "B")])
def test_normalize_answer(spark, raw, want):
    assert one(spark, raw, t.normalize_answer) == want


@pytest.mark.parametrize("raw,want", [("01022024", "2024-02-01"), ("01/02/2024", "2024-02-01"), ("010220249", "2024-02-01"), ("01022", "01/02/2"), ("010", "01/0"), ("01", "01"), ("", None)])
def test_exam_date(spark, raw, want):
    assert one(spark, raw, t.normalize_exam_date) == want


def test_error_category(spark):
    assert one(spark, "x" * 221, t.error_category) == "x" * 217 + "..."
    assert one(spark, "x" * 220, t.error_category) == "x" * 220
    assert one(spark, "Pipeline Input missing", t.error_category) == t.MSG_UNPROCESSABLE
    assert one(spark, "ZERO_VALID_QUESTIONS", t.error_category) == t.MSG_NONE_FOUND


def test_white_space_and_words(spark):
    assert one(spark, " a　b﻿c\u0085d ", t.word_count) == 3
    assert one(spark, "﻿ a  ", t.trimmed) == "a"


def content(spark, text, options):
    df = spark.createDataFrame([(text, options)], "q string, o array<string>")
    return df.select(e.content_hash(F.col("q"), F.col("o"))).collect()[0][0]


def test_content_hash(spark):
    """A leading a-e goes even from a plain word; order of options and ligatures do not matter."""
    want = hashlib.sha256("o que é x?||||||asa||um".encode()).hexdigest()
    assert content(spark, " O que  é X? ", ["A) um", "casa", "b", "c."]) == want
    assert content(spark, "ﬁm", ["A) x", "B) y"]) == content(spark, "fim", ["B) y", "A) x"])


def test_clean_and_key(spark):
    items = spark.createDataFrame(
        [(0, 1, 0, " t ", [" a", "a ", "", "b"], "C) x"), (0, 2, 5, "t", ["a", " a"], None), (0, 3, 3, "  ", ["a", "b"], None)],
        "exam_id bigint, position int, q_order int, question_text string, options array<string>, explicit_answer string")
    rows = e.clean_questions(items)
    assert [(r.q_order, r.question_text, r.options) for r in rows.collect()] == [(1, "t", ["a", "b"])]
    key = spark.createDataFrame([(0, 1, "D")], "exam_id bigint, q_order int, answer string")
    r = e.apply_answer_key(rows, key).collect()[0]
    assert (r.correct_answer, r.key_matched, r.answer_mismatch) == ("D", True, True)
    r = e.apply_answer_key(rows, key.limit(0)).collect()[0]
    assert (r.correct_answer, r.key_matched, r.answer_mismatch) == ("C", False, False)


def test_quality_gate_order(spark):
    df = spark.createDataFrame(
        [(0, 0, 0.0, False), (1, 3, 79.5, True), (2, 3, 79.0, True), (3, 3, 80.0, True), (4, 1, 80.0, False)],
        "exam_id bigint, questions bigint, confidence double, has_short_text boolean")
    got = {r.exam_id: r.reason for r in ql.quality_gate(df).collect()}
    assert got == {0: "LOW_QUESTION_COUNT:0", 1: "LOW_CONFIDENCE:79.5", 2: "LOW_CONFIDENCE:79", 3: "LOW_TEXT_QUALITY", 4: None}
    assert {r.fallback_reason for r in ql.route_exams(ql.quality_gate(df), True).collect()} == {"FORCED_BY_CONFIG"}


def test_status_changes(spark):
    cases = [
        ("queued", "start", 0, "processing", None), ("processing", "extracted", 3, "reviewing", None),
        ("processing", "extracted", 0, "failed", None), ("reviewing", "publish", 2, "completed", None),
        ("reviewing", "publish", 0, "reviewing", "NO_QUESTIONS"), ("completed", "publish", 0, "completed", None),
        ("queued", "publish", 1, "queued", "INVALID_STATE"), ("failed", "reprocess", 0, "queued", None),
        ("queued", "reprocess", 0, "queued", "EXAM_NOT_FAILED"), (None, "start", 0, None, "EXAM_NOT_FOUND")]
    exams = spark.createDataFrame([(i, s, 9) for i, (s, *_) in enumerate(cases) if s], "exam_id bigint, status string, total_questions int")
    events = spark.createDataFrame(
        [(i, 1, ev, n, "m", "2024-01-01") for i, (_, ev, n, _, _) in enumerate(cases)],
        "exam_id bigint, event_id bigint, event string, question_count int, message string, at string")
    got = {r.exam_id: (r.new_status, r.reject_code) for r in lc.advance_status(exams, events).collect()}
    assert got == {i: (new, code) for i, (*_, new, code) in enumerate(cases)}


def test_all_events_count(spark):
    """Events are folded in order of time, whatever the blocks, as the stream does it."""
    exams = spark.createDataFrame([(1, "queued", 9), (2, "failed", 4), (3, "odd", 1)], "exam_id bigint, status string, total_questions int")
    ev = [(1, 1, "start", 0, 0), (1, 2, "extracted", 5, 10), (2, 3, "reprocess", 0, 5), (2, 4, "start", 0, 5), (2, 5, "fail", 0, 90_000_000_000),
          (2, 6, "publish", 1, 90_000_000_001), (3, 7, "start", 0, 0), (4, 8, "start", 0, 0)]
    rows = spark.createDataFrame([(e, i, name, n, "msg", t) for e, i, name, n, t in ev], "exam_id bigint, event_id bigint, event string, question_count int, message string, t bigint")
    rows = rows.withColumn("at", F.timestamp_micros("t")).drop("t")
    for block in (1, 7, 86_400_000_000, 10**15):
        got = {r.exam_id: r for r in lc.advance_status(exams, rows, block).collect()}
        assert (got[1].new_status, got[1].reject_code, got[1].total_questions, got[1].error_message) == ("reviewing", None, 5, None)
        assert (got[2].old_status, got[2].new_status, got[2].reject_code, got[2].total_questions) == ("failed", "failed", "INVALID_STATE", None)
        assert got[2].processed_at is not None and got[2].error_message and got[2].event == "publish"
        assert (got[3].new_status, got[3].reject_code, got[3].event) == ("odd", "INVALID_STATE", "start")
        assert (got[4].new_status, got[4].reject_code) == (None, "EXAM_NOT_FOUND")


def test_answer_codes(spark):
    sessions = spark.createDataFrame([(1, 0, None), (2, 0, "x")], "session_id bigint, exam_id bigint, finished_at string")
    qs = spark.createDataFrame([(0, 1, "b) x")], "exam_id bigint, q_order int, correct_answer string")
    tries = [(1, 1, 1, "Z"), (2, 9, 1, "A"), (3, 2, 1, "A"), (4, 1, 7, "A"), (5, 1, 1, "b"), (6, 1, 1, "A")]
    att = spark.createDataFrame([(*r, r[0]) for r in tries], "event_id bigint, session_id bigint, q_order int, raw_answer string, answered_at bigint")
    got = z.accept_answers(att, sessions, qs)
    assert {r.event_id: r.reject_code for r in got.collect()} == {
        1: "INVALID_INPUT", 2: "SESSION_NOT_FOUND", 3: "SESSION_FINISHED", 4: "QUESTION_NOT_FOUND", 5: None, 6: "QUESTION_ALREADY_ANSWERED"}
    first = z.first_answers(att, sessions, qs)
    assert [r.event_id for r in first.collect()] == [5]
    assert z.grade_answers(first, qs).collect()[0].is_correct


def test_score_rounding(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (0, 0)], "c int, t int")
    assert [r[0] for r in df.select(z.score_percent(F.col("c"), F.col("t"))).collect()] == [33.33, 66.67, 0.0]


def test_parse_classifications(spark):
    good = {"index": 0, "subject": " s ", "topic": "t", "difficulty": "easy"}
    cases = [("{oops", "CLASSIFICATION_INVALID_JSON"), ("{}", "CLASSIFICATION_INVALID_SCHEMA"), ('{"items":[]}', "CLASSIFICATION_INVALID_SCHEMA"),
             (json.dumps({"items": [good]}), None), (json.dumps({"items": [{**good, "index": 0.5}]}), "CLASSIFICATION_INVALID_SCHEMA"),
             (json.dumps({"items": [{**good, "subject": " "}, {**good, "difficulty": "HARD"}]}), "CLASSIFICATION_INVALID_SCHEMA")]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, response string")
    rows = {r.i: r for r in c.parse_classifications(df).collect()}
    assert {i: r.error for i, r in rows.items()} == {i: w for i, (_, w) in enumerate(cases)}
    assert rows[3]["items"][0].subject == "s"
    odd = ["x", None, 5, [], {**good, "subject": 5}, {**good, "subject": {"a": 1}}, {**good, "index": "0"}, {**good, "index": True}, {**good, "index": 1.0}]
    more = spark.createDataFrame([(json.dumps({"items": [*odd, {**good, "index": 3}]}),), (json.dumps({"items": {"a": good}}),), (json.dumps([good]),), (None,)], "response string")
    first, *others = c.parse_classifications(more).collect()
    assert [i["index"] for i in first["items"]] == [1, 3] and first.error is None
    assert [r.error for r in others] == ["CLASSIFICATION_INVALID_SCHEMA"] * 2 + ["CLASSIFICATION_INVALID_JSON"]
    assert [c._valid_item(i) for i in [*odd, good]] == [False] * 8 + [True, True]


def test_model_retries_and_timeouts(spark):
    df = spark.createDataFrame([(0, 0, "bad"), (0, 1, "slow"), (0, 2, "ok"), (0, 3, "down")], "exam_id bigint, batch_no int, prompt string")

    def model(prompt):
        if prompt == "slow":
            raise TimeoutError
        if prompt == "down":
            raise ValueError("503")
        if prompt == "bad":
            return "{}", 10, 2
        return "{}" if prompt == "bad" else json.dumps({"items": [{"index": 0, "subject": "s", "topic": "t", "difficulty": "hard"}]})

    got = {r.batch_no: (r.timed_out, r.attempts, r.error, r.prompt_tokens) for r in c.classify_with(df, model).collect()}
    assert got == {0: (False, 3, None, 30), 1: (True, 1, "TIMEOUT", 0), 2: (False, 1, None, 0), 3: (False, 1, "ValueError: 503", 0)}


def test_daily_budget(spark):
    df = spark.createDataFrame([("2024-01-01", i, 0.4) for i in range(5)] + [("2024-01-02", 9, 5.0)], "day string, seq bigint, cost_usd double")
    df = df.withColumn("day", F.col("day").cast("date"))
    for block in (1, 2, 100):
        got = {r.seq: (r.runs, str(r.due_day)) for r in c.daily_budget(df, block=block).collect()}
        assert [got[i][0] for i in range(5)] == [True, True, True, False, False] and got[9][0]
        assert got[3][1] == "2024-01-02"
    assert all(r.runs for r in c.daily_budget(df, replace(CLASSIFICATION, daily_usd=0.0)).collect())


def test_daily_budget_carries_over(spark):
    """Thirty days with overflow, idle days, free batches and a backlog after the last day, against a plain queue."""
    rng = random.Random(5)
    rows = [(d, i, rng.choice([0.0, 0.1, 0.25, 0.3, 1.7, None])) for d in range(30) if d % 9 not in (4, 5, 6) for i in range(rng.randint(0, 12))]
    rows += [(29, 100 + i, 0.7) for i in range(20)]
    first = datetime.date(2024, 1, 1)
    df = spark.createDataFrame([(first + datetime.timedelta(d), s, x, "x") for d, s, x in rows], "day date, seq bigint, cost_usd double, k string")
    want, day, spent = {}, -1, 0
    for d, s, x in sorted(rows, key=lambda r: r[:2]):
        if d > day or spent >= 100:
            day, spent = max(d, day + (spent >= 100)), 0
        want[d, s] = (day, spent, day == d)
        spent += round((x or 0) * 100)
    for block in (3, 65536):
        got = c.daily_budget(df.repartition(4), block=block).collect()
        assert {((r.day - first).days, r.seq): ((r.due_day - first).days, round(float(r.cost_before) * 100), r.runs) for r in got} == want
    assert max(v[0] for v in want.values()) > 35
    assert c.daily_budget(df.limit(0)).collect() == []


def test_chunks_against_brute_force(spark):
    texts = ["", "a" * 50, "\n".join("x" * n for n in (5, 9, 30, 1, 1, 1, 20)), PAGE_SEPARATOR.join("y" * n for n in (10, 12, 3, 40))]

    def brute(text, limit):
        sep = PAGE_SEPARATOR if PAGE_SEPARATOR in text else "\n"
        out, cur, size = [], [], 0
        for p in text.split(sep):
            if cur and size + len(p) > limit:
                out.append(sep.join(cur))
                cur, size = [p], len(p)
            else:
                cur.append(p)
                size += len(p) + len(sep)
        return [*out, sep.join(cur)]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for limit in (10, 25, 1000):
        got = x.chunk_text(df, limit).orderBy("doc_id", "chunk").collect()
        assert [(r.doc_id, r.text) for r in got] == [(i, p) for i, text in enumerate(texts) for p in brute(text, limit)]


def test_reader_failures_are_rows(spark, tmp_path):
    for n in ("a.txt", "b.txt", "c.bin"):
        (tmp_path / n).write_bytes(n.encode())

    def fn(path, content):
        if path.endswith("b.txt"):
            raise ValueError("no")
        return content.decode(), 1.0

    files = readers.read_documents(spark, str(tmp_path), "*.txt")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in x.extract_with(files, fn).collect()}
    assert got == {"a.txt": ("a.txt", None), "b.txt": ("", "ValueError:no")}
    wanted = files.select("path").unionByName(spark.createDataFrame([("gone.pdf",)], "path string"))
    assert [r.error_code for r in readers.missing_documents(wanted, files).collect()] == ["FILE_NOT_FOUND:gone.pdf"]


def test_upload_forms(spark):
    cases = [("1", "2", None, "application/pdf", 1, None), ("0", "2", None, "application/pdf", 1, "page_start"), ("x", None, None, "application/pdf", 1, "page_start"),
             ("3", "-1", None, "application/pdf", 1, "page_end"), ("3", "2", "nope", "x", 0, "page_range"), (" ", "", " ", "image/png", 1, None),
             (None, None, "nope", "x", 0, "template_id"), (None, None, "escriturario", "x", 0, "content_type"),
             (None, None, None, "image/webp", 0, "size_bytes"), (None, None, None, "image/webp", 25 * 1024 * 1024 + 1, "size_bytes")]
    df = spark.createDataFrame(
        [(i, "dir/a b.c.PDF" if i else ".hidden", ct, n, a, b, " b ", tp) for i, (a, b, tp, ct, n, _) in enumerate(cases)],
        "upload_id int, filename string, content_type string, size_bytes bigint, page_start string, page_end string, prova_type string, template_id string")
    rows = {r.upload_id: r for r in readers.validate_uploads(df).collect()}
    assert {i: r.reject_field for i, r in rows.items()} == {i: w for i, (*_, w) in enumerate(cases)}
    assert rows[1].safe_name == "a_b.c.PDF" and rows[0].safe_name == ".hidden.pdf" and rows[0].booklet == "B"


def test_table_replacement(spark, tmp_path):
    path = str(tmp_path / "q")
    rows = lambda *r: spark.createDataFrame(list(r), "exam_id bigint, q_order int, t string")
    sinks.write_exam_table(rows((1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d")), path, 4)
    touched = spark.createDataFrame([(1,), (2,)], "exam_id bigint")
    new = rows((1, 1, "new"))
    for _ in range(2):  # repeating it changes nothing
        sinks.replace_in_table(spark, path, new, touched, 4)
        got = sorted(map(tuple, sinks.read_exam_table(spark, path, new.schema).collect()))
        assert got == [(1, 1, "new"), (3, 1, "d")]
    sinks.replace_in_table(spark, path, new.limit(0), spark.createDataFrame([(1,), (3,)], "exam_id bigint"), 4)
    assert sinks.read_exam_table(spark, path, new.schema).count() == 0


def test_a_view_of_some_columns_derives_no_others(spark, tmp_path, monkeypatch):
    from examlens.registry import fixtures as fx

    spark.createDataFrame([(i, "w " * 40) for i in range(20)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    narrow = fx.view(spark, str(tmp_path), "fx_questions", "exam_id", "q_order", "correct_answer")
    assert narrow.columns == ["exam_id", "q_order", "correct_answer"]
    stored = spark.read.parquet(narrow.inputFiles()[0].rsplit("/", 1)[0])
    assert stored.columns == narrow.columns
    whole = fx.view(spark, str(tmp_path), "fx_questions")
    assert sorted(map(repr, narrow.collect())) == sorted(map(repr, whole.select(*narrow.columns).collect())) and narrow.count() == 20


def test_questions_are_not_broadcast_to_answers(spark, tmp_path):
    spark.createDataFrame([(1, 1, "A")], "exam_id bigint, q_order int, correct_answer string").write.parquet(f"{tmp_path}/q")
    known = spark.read.parquet(f"{tmp_path}/q")
    accepted = spark.createDataFrame([(1, 1, 1, "A")], "session_id bigint, exam_id bigint, q_order int, answer string")
    graded = z.grade_answers(accepted, known)
    assert "BroadcastHashJoin" not in graded._jdf.queryExecution().sparkPlan().toString() and graded.collect()[0].is_correct
