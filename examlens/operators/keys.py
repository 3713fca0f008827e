"""Answer keys: from reading-order lines to one answer per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.config import PARSER
from examlens.functions.ordered import carry_forward
from examlens.functions.text import WS, extract, trimmed

# Patterns of key headers, annulment notes and answer pairs, in the order tried.
HEADER = r"(?i)(?<![A-Za-z0-9_])(?:gabarito|prova)(?![A-Za-z0-9_])"
HEADER_KEY = r"(?i)(?<![A-Za-z0-9_])gabarito(?![A-Za-z0-9_])"
TYPE_EXAM = rf"(?i)(?<![A-Za-z0-9_])prova[{WS}]*[:\-]?[{WS}]*([A-D])(?![A-Za-z0-9_])"
TYPE_KEY_EXAM = (
    rf"(?is)(?<![A-Za-z0-9_])gabarito(?![A-Za-z0-9_]).{{0,20}}?"
    rf"(?<![A-Za-z0-9_])prova[{WS}]*[:\-]?[{WS}]*([A-D])(?![A-Za-z0-9_])"
)
TYPE_KEY = rf"(?i)(?<![A-Za-z0-9_])gabarito[{WS}]*[:\-]?[{WS}]*([A-D])(?![A-Za-z0-9_])"
ANNULLED = r"(?i)anulad[ao]"
_PAIR = rf"(?:^|[{WS},;])[0-9]{{1,3}}%s[A-Ea-e*](?=\z|[{WS},;])"
PAIRS = [_PAIR % x for x in (rf"[{WS}]*[-–:.][{WS}]*", rf"[{WS}]+", rf"\)[{WS}]*", "")]

MAX_NUMBER = 200
MIN_ANSWERS = 10
WHOLE_DOCUMENT = -1


def booklet_type(text: Column) -> Column:
    """Booklet letter A-D named in a header."""
    return F.upper(F.coalesce(extract(text, TYPE_EXAM), extract(text, TYPE_KEY_EXAM), extract(text, TYPE_KEY)))


def split_key_sections(lines: DataFrame, block: int = PARSER.block_lines) -> DataFrame:
    """Section (line number of its header) and booklet type of every line.

    Lines before the first header are dropped; without any header the whole
    document is one section.
    """
    t = trimmed(F.col("text"))
    kind = booklet_type(t)
    is_header = F.regexp_like(t, F.lit(HEADER)) & (kind.isNotNull() | F.regexp_like(t, F.lit(HEADER_KEY)))
    at = F.when(is_header, F.col("line_no"))
    d = carry_forward(
        lines, ["exam_id"], "line_no",
        {"_head": F.when(is_header, F.struct(F.col("line_no"), kind.alias("booklet")))},
        block, firsts={"_first": at},
    )
    whole = F.col("_first").isNull()
    return d.filter(whole | F.col("_head").isNotNull()).select(
        *lines.columns,
        F.when(whole, F.lit(WHOLE_DOCUMENT)).otherwise(F.col("_head")["line_no"]).alias("section"),
        F.col("_head")["booklet"].alias("booklet"),
    )


def _pairs(text: Column) -> Column:
    """All pairs of a line as array<struct<pattern, pos, q_order, answer>>."""

    def of(i: int, pattern: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), 0)
        return F.transform(hits, lambda m, pos: F.struct(
            F.lit(i).alias("pattern"),
            pos.cast("int").alias("pos"),
            F.regexp_extract(m, "[0-9]+", 0).cast("int").alias("q_order"),
            F.upper(F.right(m, F.lit(1))).alias("answer"),
        ))

    return F.concat(*[of(i, p) for i, p in enumerate(PAIRS, 1)])


def extract_answer_pairs(lines: DataFrame) -> DataFrame:
    """Number-letter pairs of every line."""
    return lines.select("*", F.inline(_pairs(F.col("text")))).drop("text")


def annulled_numbers(lines: DataFrame) -> DataFrame:
    """The first number on a line that says a question is annulled."""
    number = extract(F.col("text"), "([0-9]{1,3})").cast("int")
    return lines.filter(F.regexp_like("text", F.lit(ANNULLED))).select(
        *[c for c in lines.columns if c != "text"], number.alias("q_order")
    ).filter("q_order is not null")


def section_sizes(sectioned: DataFrame) -> DataFrame:
    """Pairs seen per section."""
    return sectioned.groupBy("exam_id", "section").agg(
        F.max("booklet").alias("booklet"), F.sum(F.size(_pairs(F.col("text")))).alias("pairs")
    )


def select_key_section(sections: DataFrame, exams: DataFrame) -> DataFrame:
    """C4: the sections to read, given ``exams(exam_id, booklet)`` as the wanted booklets.

    ``sections(exam_id, section, booklet, pairs, ...)``. Per exam only a set of
    at most four booklet letters and one best section are kept.
    """
    choice = sections.groupBy("exam_id").agg(
        F.collect_set("booklet").alias("_types"),
        F.max_by("section", F.struct("pairs", -F.col("section"))).alias("_best"),
    )
    wanted = exams.select("exam_id", extract(F.upper(trimmed(F.col("booklet"))), r"^([A-D])\z").alias("_wanted"))
    choice = choice.join(wanted, "exam_id", "left").withColumn(
        "_match", F.coalesce(F.array_contains("_types", F.col("_wanted")), F.lit(False)))
    keep = (
        F.when(F.col("_match"), F.coalesce(F.col("booklet") == F.col("_wanted"), F.lit(False)))
        .when(F.size("_types") > 1, F.col("section") == F.col("_best"))
        .otherwise(True)
    )
    return sections.join(choice, "exam_id").filter(keep).select(*sections.columns)


def resolve_answers(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The first pair of a question wins; ``*`` means annulled."""
    return (
        pairs.filter(F.col("q_order").between(1, MAX_NUMBER))
        .groupBy(*by, "q_order")
        .agg(F.min(F.struct("line_no", "pattern", "pos", "answer")).alias("_first"))
        .select(*by, "q_order", F.col("_first")["answer"].alias("answer"),
                (F.col("_first")["answer"] == "*").alias("annulled"))
    )


def apply_annulments(resolved: DataFrame, annulled: DataFrame) -> DataFrame:
    """An annulment note overrides a letter."""
    notes = annulled.groupBy("exam_id", "q_order").agg(F.lit(True).alias("_note"))
    return resolved.join(notes, ["exam_id", "q_order"], "full").select(
        "exam_id", "q_order",
        F.when(F.coalesce("_note", F.lit(False)) | F.col("annulled"), F.lit("*")).otherwise(F.col("answer")).alias("answer"),
        (F.coalesce("_note", F.lit(False)) | F.coalesce("annulled", F.lit(False))).alias("annulled"),
    )


def _resolved_sections(sectioned: DataFrame) -> DataFrame:
    """One row per section with its booklet, its pairs and what it says per question.

    The numbers of a section have at most three digits, so ``found`` is short.
    Everything else is derived from it: the frame is used twice, and with a
    single aggregate both uses share one shuffle.
    """
    note = F.when(F.regexp_like("text", F.lit(ANNULLED)), extract(F.col("text"), "([0-9]{1,3})").cast("int"))
    notes = F.when(note.isNotNull(), F.array(F.struct(
        F.lit(0).alias("pattern"), F.lit(0).alias("pos"), note.alias("q_order"), F.lit("*").alias("answer")
    ))).otherwise(F.array())
    events = sectioned.select(
        "exam_id", "section", "booklet", "line_no", F.inline_outer(F.concat(_pairs(F.col("text")), notes))
    )
    is_pair = F.col("pattern") > 0
    usable = is_pair & F.col("q_order").between(1, MAX_NUMBER)
    per_question = events.groupBy("exam_id", "section", "q_order").agg(
        F.max("booklet").alias("booklet"),
        F.count_if(is_pair).alias("pairs"),
        F.count_if(usable).alias("usable"),
        F.min(F.when(usable, F.struct("line_no", "pattern", "pos", "answer"))).alias("first"),
        F.coalesce(F.bool_or(F.col("pattern") == 0), F.lit(False)).alias("note"),
    )
    found = per_question.groupBy("exam_id", "section").agg(
        F.collect_list(F.struct("q_order", "booklet", "pairs", "usable", "first", "note")).alias("found"))
    return found.select(
        "exam_id", "section",
        F.array_max(F.transform("found", lambda f: f["booklet"])).alias("booklet"),
        F.aggregate("found", F.lit(0).cast("bigint"), lambda n, f: n + f["pairs"]).alias("pairs"),
        "found",
    )


def resolve_keys(lines: DataFrame, exams: DataFrame, block: int = PARSER.block_lines) -> DataFrame:
    """C1-C6 composed: answer or annulment per question of the selected sections."""
    chosen = select_key_section(_resolved_sections(split_key_sections(lines, block)), exams)
    return (
        chosen.select("exam_id", F.explode("found").alias("f"))
        .select("exam_id", "f.q_order", "f.first", "f.note", "f.usable")
        .filter("q_order is not null")
        .groupBy("exam_id", "q_order")
        .agg(F.min("first")["answer"].alias("answer"), F.bool_or("note").alias("note"), F.sum("usable").alias("pairs"))
        .filter("answer is not null or note")
        .select("exam_id", "q_order",
                F.when(F.col("note"), F.lit("*")).otherwise(F.col("answer")).alias("answer"),
                (F.col("note") | (F.col("answer") == "*")).alias("annulled"), "pairs")
    )


def answer_key_stats(resolved: DataFrame) -> DataFrame:
    """Counts per exam and the low-coverage flag."""
    return resolved.groupBy("exam_id").agg(
        F.count_if(~F.col("annulled")).alias("answers"),
        F.count_if(F.col("annulled")).alias("annulled"),
        F.count("*").alias("total"),
        F.sum("pairs").alias("pairs"),
    ).withColumn("low_coverage", F.col("total") < MIN_ANSWERS)


def parse_answer_keys(lines: DataFrame, exams: DataFrame, block: int = PARSER.block_lines) -> DataFrame:
    """Letters per question; annulled questions are left out."""
    return resolve_keys(lines, exams, block).filter("not annulled and q_order > 0").select("exam_id", "q_order", "answer")
