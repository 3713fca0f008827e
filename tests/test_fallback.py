"""Ledger of calls and the fallback tier: lost workers, failed calls, plain counterparts."""

import json
import os
import time
from collections import Counter

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from examlens.operators import ledger as lg
from examlens.operators import texttier as x
from examlens.plans import fallback as fb


def _requests(spark, n):
    return spark.range(n).select(F.col("id"), lg.call_id(F.lit("t"), F.col("id")).alias("call_id"), F.concat(F.lit("p"), "id").alias("prompt"))


def test_a_killed_job_keeps_its_answers(spark, tmp_path):
    log, down, n = str(tmp_path / "log"), str(tmp_path / "down"), 40
    open(down, "w").close()

    def fn(prompt):
        if os.path.exists(down) and int(prompt[1:]) % 2:
            time.sleep(4)
            os._exit(1)
        with open(log, "a") as f:
            f.write(prompt + "\n")
        return (prompt * 2,)

    ask = lambda: lg.call_once(_requests(spark, n), fn, ["prompt"], "said string", str(tmp_path / "ledger"), target=1)
    with pytest.raises((PySparkException, Py4JJavaError)):
        ask()
    kept = {r.said for r in lg.read_ledger(spark, str(tmp_path / "ledger"), "said string").collect()}
    assert kept
    os.remove(down)
    for _ in range(2):
        assert sorted((r.id, r.said, r.error) for r in ask().collect()) == [(i, f"p{i}p{i}", None) for i in range(n)]
    calls = Counter(open(log).read().split())
    assert set(calls) == {f"p{i}" for i in range(n)}
    # What was answered before the job died, and all of the rerun, was called once.
    assert all(calls[said[: len(said) // 2]] == 1 for said in kept)


def test_errors_and_repeated_requests(spark, tmp_path):
    log, down = str(tmp_path / "log"), str(tmp_path / "down")
    open(down, "w").close()

    def fn(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if os.path.exists(down) and prompt == "p1":
            raise ValueError("no")
        return (prompt, 1)

    twice = _requests(spark, 3).unionByName(_requests(spark, 3))
    ask = lambda again: sorted(
        (r.id, r.said, r.n, r.error) for r in lg.call_once(
            twice, fn, ["prompt"], "said string, n int", str(tmp_path / "ledger"), ask_again=again).collect())
    failed = [(0, "p0", 1, None)] * 2 + [(1, None, None, "ValueError:no")] * 2 + [(2, "p2", 1, None)] * 2
    assert ask(False) == failed
    os.remove(down)
    assert ask(False) == failed
    assert ask(True)[2:4] == [(1, "p1", 1, None)] * 2
    assert Counter(open(log).read().split()) == {"p0": 1, "p1": 2, "p2": 1}
    none = lg.call_once(twice.limit(0), fn, ["prompt"], "said string, n int", str(tmp_path / "empty"))
    assert none.collect() == []


def test_tasks_hold_a_target_and_one_row(spark):
    sizes = [10 ** (i % 6) for i in range(300)] + [None, 0]
    df = spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(sizes)], "path string, length bigint")
    dealt = lg.dealt(df, "path", F.col("length"), 50_000)
    parts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("length").alias("s"), F.max("length").alias("m")).collect()
    assert sum(r.s or 0 for r in parts) == sum(v or 0 for v in sizes)
    assert all((r.s or 0) <= 50_000 + r.m for r in parts if r.m)
    files = df.withColumn("content", F.encode("path", "UTF-8"))
    read = x.extract_with(files, lambda path, content: (content.decode(), 1.0), 50_000)
    assert sorted(r.text for r in read.collect()) == sorted(f"f{i}" for i in range(len(sizes)))


def _model():
    """A JSON list in each line of the text; the word ``down`` is a failed call, ``odd`` an answer that is no list."""
    start = fb.PROMPT

    def model(prompt):
        text = prompt.removeprefix(start)
        if "down" in text:
            raise RuntimeError("quota")
        if "odd" in text:
            return "{"
        return json.dumps({"questions": [q for line in text.split("\n") if line.startswith("[") for q in json.loads(line)]})

    return model


def _q(n, text, options=("A) x", "B) y")):
    return {"order": n, "questionText": text, "options": list(options), "correctAnswer": "a"}


def _line(*qs):
    return json.dumps(qs)


def test_outcomes_of_awkward_exams(spark, tmp_path):
    pad = "z" * 200
    texts = {
        1: "\n".join([pad, _line(_q(2, "two"), _q(1, "one")), pad, _line(_q(2, "late"), _q(3, " three "))]),  # first wins over chunks
        2: "\n".join([pad, _line(_q(0, "zero"))]),
        3: "\n".join([pad, _line(_q(1, ""))]),
        4: "\n".join([pad, _line(_q(1, "one")), pad + "down"]),
        5: "\n".join([pad, "odd"]),
        6: pad,  # no question at all
        7: "\n".join([pad, _line(_q(1, "one", ["A) x"]))]),  # nothing is left once cleaned
        8: None,
        9: "broken",
        10: "",  # structured by its name alone
    }

    def primary(name, content):
        text = content.decode()
        if text == "broken":
            raise OSError("torn")
        return text, 0.9

    tier = fb.Tier(primary, lambda name, content: ("", 0.0), _model(), max_chars=150)
    ids = spark.createDataFrame([(i,) for i in [*texts, 11, 12]], "exam_id bigint")
    routed = ids.select("exam_id", F.when(F.col("exam_id") == 12, "fastpath").otherwise("fallback").alias("tier"),
                        (F.col("exam_id") == 12).alias("acceptable"), F.lit("LOW").alias("fallback_reason"))
    files = spark.createDataFrame([(i, f"{i}.pdf", t.encode() if t is not None else None) for i, t in texts.items()],
                                  "exam_id bigint, filename string, content binary")
    keys = spark.createDataFrame([(1, 3, "E")], "exam_id bigint, q_order int, answer string")
    exams = ids.select("exam_id", F.lit(None).cast("string").alias("template_id"), (F.col("exam_id") == 1).alias("has_key"))
    rows, outcome = fb.fallback_exams(routed, files, keys, exams, tier, str(tmp_path / "ledger"))
    assert sorted((r.exam_id, r.q_order, r.question_text, r.correct_answer, r.key_matched) for r in rows.collect()) == [
        (1, 1, "one", "A", False), (1, 2, "two", "A", False), (1, 3, "three", "E", True)]
    got = {r.exam_id: r for r in outcome.collect()}
    assert {i: r.error for i, r in got.items()} == {
        1: None, 2: fb.INVALID, 3: fb.INVALID,
        4: "PIPELINE_RUNTIME_ERROR:GEMINI_EXTRACTION_FAILED on chunk 3: RuntimeError:quota",
        5: "PIPELINE_RUNTIME_ERROR:GEMINI_EXTRACTION_FAILED on chunk 2: ValueError:not a list of questions",
        6: fb.INVALID, 7: "ZERO_VALID_QUESTIONS", 8: fb.NO_FILE, 9: "PIPELINE_RUNTIME_ERROR:OSError:torn", 10: fb.INVALID, 11: fb.NO_FILE}
    assert (got[1].status, got[1].health, got[1].inserted, got[1].questions_expected) == ("reviewing", "degraded", 3, 1)
    assert (got[10].used_path, got[10].read_reason) == (fb.SHORT_PATH, "LOW|LOW_EXTRACTION_CHARS:0")
    old = spark.createDataFrame([(i, 9, "old") for i in (1, 2, 7, 12)], "exam_id bigint, q_order int, question_text string")
    stored = fb.stored_rows(old, rows, outcome)
    assert sorted((r.exam_id, r.question_text) for r in stored.collect()) == [(1, "one"), (1, "three"), (1, "two"), (2, "old"), (12, "old")]
    events = fb.outcome_events(outcome, F.lit("2024-01-01").cast("timestamp")).filter("event_id = 1")
    assert {r.exam_id: r.event for r in events.collect() if r.exam_id in (1, 2, 7)} == {1: "extracted", 2: "fail", 7: "extracted"}


def test_no_exam_for_the_tier(spark, tmp_path):
    tier = fb.Tier(lambda n, c: ("", 0.0), lambda n, c: ("", 0.0), _model())
    none = spark.createDataFrame([], "exam_id bigint, tier string, acceptable boolean, fallback_reason string")
    files = spark.createDataFrame([], "exam_id bigint, filename string, content binary")
    keys = spark.createDataFrame([], "exam_id bigint, q_order int, answer string")
    exams = spark.createDataFrame([], "exam_id bigint, template_id string, has_key boolean")
    rows, outcome = fb.fallback_exams(none, files, keys, exams, tier, str(tmp_path / "ledger"))
    assert rows.collect() == [] and outcome.collect() == []


def test_what_is_asked_is_made_once(spark, tmp_path, monkeypatch):
    """Requests are read several times by ``call_once``: they come from files, not from the chunking plan."""
    asked = []

    def kept(requests, *args, **kw):
        asked.append(requests)
        return lg.call_once(requests, *args, **kw)

    monkeypatch.setattr(fb, "call_once", kept)
    text = "\n".join(f"{i}. um texto de questao" for i in range(1, 9))
    routed = spark.createDataFrame([(1, "fallback", "r")], "exam_id bigint, tier string, fallback_reason string")
    files = spark.createDataFrame([(1, "a.pdf", bytearray(text.encode()))], "exam_id bigint, filename string, content binary")
    tier = fb.Tier(lambda n, c: (bytes(c).decode(), 1.0), lambda n, c: ("", 0.0), lambda p: '{"questions": []}', min_chars=1, max_chars=60)
    texts = fb.read_texts(routed, files, tier, str(tmp_path / "ledger"))
    assert fb.structure_texts(texts, tier, str(tmp_path / "ledger")).count() > 2
    first, _, chunks = asked
    assert first.inputFiles() and chunks.inputFiles()
    assert not any("collect_list" in p or "aggregate(" in p for p in (r._jdf.queryExecution().optimizedPlan().toString() for r in asked))
