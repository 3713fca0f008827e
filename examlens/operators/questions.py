"""Reading-order lines to multiple-choice questions.

A number is accepted by the last *confirmed* question, so acceptance depends on what
was read before. Only small rows follow that order: one per numbered line, with the
number of words, options and marks up to the next numbered line. A scan over them
(`numbers.py`) gives the span of lines of every item and its verdict; the text
moves once, to the items that are wanted.

Tables that grow with the exams (pages, numbered lines, items, shared texts, rows of one exam each) are joined by merge: read from files, their size is
estimated from compressed bytes, and one that looks small is many times that when it is broadcast through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlens.config import PARSER, Parser
from examlens.functions.ordered import carry_forward
from examlens.functions.text import LETTERS, SPACES, WS, extract, trimmed, word_count
from examlens.operators.numbers import (
    END, MISSING_PENALTY, OPTION_POINTS, OPTION_WORDS, OPTION_WORDS_POINTS, SOURCE_PENALTY, STEM_POINTS, STEM_WORDS, TRUNCATED_PENALTY, Scan, scan_numbers)
from examlens.sources.sinks import materialize

# Line patterns.
SCRATCH = r"(?is)(?<![A-Za-z0-9_])RASCUNHO(?![A-Za-z0-9_]).*"
NUMBER_ALONE = rf"^[{WS}]*([0-9]{{1,2}})[{WS}]*\z"
NUMBER_START = rf"^[{WS}]*([0-9]{{1,2}})[{WS}]*[.\-–—)][{WS}]+"
OPTION = rf"^[{WS}]*\(([A-E])\)[{WS}]*"
INLINE_OPTION = rf"[{WS}]+\(([B-E])\)[{WS}]*"
SHARED_RANGE = rf"(?iu)quest[õo]es?[{WS}]+([0-9]{{1,2}})[{WS}]+[ae][{WS}]+([0-9]{{1,2}})"
SHARED_LEAD = (
    "(?iu)^(Leia|Com base|Considere|A partir|Segundo|Observe|Analise"
    "|O texto|O trecho|O fragmento|Os textos)"
)
_PIECE = "\x01"
_FIRST = 15  # on a line with several options the first is set last, and is continued


def _has(c: Column | str, word: str) -> Column:
    """Is the upper-cased word in the text? A plain search that all a pattern's lines pass, in front of the slow pattern:
    filters on what a pattern gives are pushed down and run it again."""
    return F.contains(F.upper(c), F.lit(word))


def strip_scratch(lines: DataFrame) -> DataFrame:
    """Cut scratch-paper marks; lines with nothing left are dropped."""
    cut = F.regexp_replace("text", SCRATCH, "")
    stripped = F.when(cut == F.col("text"), cut).otherwise(F.rtrim(cut, F.lit(SPACES)))
    text = F.when(_has("text", "RASCUNHO"), stripped).otherwise(F.col("text"))
    return lines.withColumn("text", text).filter(F.col("text") != "")


def classify_lines(lines: DataFrame) -> DataFrame:
    """Kind of each line with what it captures; first matching kind wins."""
    t = F.col("text")
    letter = F.ascii(t).between(65, 90) | F.ascii(t).between(97, 122)  # no number or option mark begins so
    alone, start, option = (F.when(~letter, extract(t, p)) for p in (NUMBER_ALONE, NUMBER_START, OPTION))
    first = F.when(_has(t, "QUEST"), extract(t, SHARED_RANGE, 1))
    kind = (
        F.when(alone.isNotNull(), "alone")
        .when(start.isNotNull(), "start")
        .when(option.isNotNull(), "option")
        .when(first.isNotNull(), "range")
        .when(F.regexp_like(t, F.lit(SHARED_LEAD)), "lead")
        .otherwise("body")
    )
    k = F.col("kind")
    rest = (
        F.when(k == "alone", F.lit(""))
        .when(k == "start", trimmed(F.regexp_replace(t, NUMBER_START, "")))
        .when(k == "option", trimmed(F.regexp_replace(t, OPTION, "")))
        .otherwise(t)
    )
    return lines.withColumn("kind", kind).select(
        *lines.columns,
        "kind",
        F.when(k.isin("alone", "start"), F.coalesce(alone, start).cast("int")).alias("num"),
        F.when(k == "option", option).alias("letter"),
        F.when(k == "range", first.cast("int")).alias("first"),
        F.when(k == "range", extract(t, SHARED_RANGE, 2).cast("int")).alias("last"),
        rest.alias("rest"),
    )


def _inline(rest: Column) -> Column:
    return F.split(F.regexp_replace(rest, INLINE_OPTION, _PIECE + "$1"), _PIECE)


def split_inline_options(classified: DataFrame) -> DataFrame:
    """One row per option on an option line."""
    # An option line has a part; the outer form asks for no filter on it, which would be pushed down and run the patterns again.
    parts = classified.filter("kind = 'option'").select(
        "exam_id", "page", "line_no", "letter", F.posexplode_outer(_inline(F.col("rest"))).alias("k", "part")
    )
    first = F.col("k") == 0
    return parts.select(
        "exam_id", "page", "line_no", "k",
        F.when(first, F.col("letter")).otherwise(F.substring("part", 1, 1)).alias("letter"),
        trimmed(F.when(first, F.col("part")).otherwise(F.expr("substring(part, 2)"))).alias("text"),
    )


# --- numbering -------------------------------------------------------------


def _option_sets(rest: Column) -> Column:
    """Option letters of a line with their words, in the order in which they are set."""
    parts = _inline(rest)
    later = F.transform(F.slice(parts, 2, F.size(parts)), lambda p, i: F.struct(F.substring(p, 1, 1).alias("letter"), word_count(F.substr(p, F.lit(2))).alias("words"), (i + 1).alias("k")))
    first = F.struct(F.col("letter"), word_count(parts[0]).alias("words"), F.lit(_FIRST).alias("k"))
    return F.concat(later, F.array(first))


def number_spans(classified: DataFrame, pages: DataFrame | None = None, cfg: Parser = PARSER) -> DataFrame:
    """A row for each numbered line with what follows up to the next one, one for what comes before the first (``span`` -1),
    and with each the first line of a shared text and the span's last line. No text leaves the lines."""
    t = F.col("text")
    # The end of a text decides; one character may still follow that counts as a line's end but is not trimmed.
    ends = lambda c: F.regexp_like(F.substring(trimmed(c), -2, 2), F.lit("[.?!:;]$"))
    numbered = F.col("kind").isin("alone", "start")
    slim = classified.filter("exam_id is not null and line_no is not null").select(
        "exam_id", "page", "line_no", "kind", "num", "letter",
        F.when(numbered, word_count(F.col("rest"))).alias("own_w"), F.when(numbered, ends(F.col("rest"))).alias("own_e"), word_count(t).alias("raw_w"), ends(t).alias("raw_e"),
        F.when(F.col("kind") == "option", _option_sets(F.col("rest"))).alias("sets"),
    )
    line = F.col("line_no")
    spans = carry_forward(
        slim, ["exam_id"], "line_no", {"span": F.when(numbered, line)}, cfg.block_lines,
        {"shared_line": F.when(F.col("kind").isin("range", "lead"), line)}).withColumn("span", F.coalesce("span", F.lit(-1)))
    w = Window.partitionBy("exam_id", "span").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    roles = spans.withColumn("opt", F.last(F.when(F.col("kind") == "option", F.struct("line_no", "letter")), ignorenulls=True).over(w))
    head = F.struct(F.lit("head").alias("letter"), F.col("raw_w").alias("words"), F.lit(0).cast("bigint").alias("mark"))
    continued = F.struct(F.col("opt.letter").alias("letter"), F.col("raw_w").alias("words"), (F.col("opt.line_no").cast("bigint") * 16 + _FIRST).alias("mark"))
    placed = F.transform("sets", lambda x: F.struct(x["letter"].alias("letter"), x["words"].alias("words"), (line.cast("bigint") * 16 + x["k"]).alias("mark")))
    here = F.when(numbered, F.array(F.struct(F.lit("number").alias("letter"), F.lit(0).alias("words"), F.lit(0).cast("bigint").alias("mark")))).when(
        F.col("kind") == "option", placed).otherwise(F.array(F.when(F.col("opt").isNull(), head).otherwise(continued)))
    pieces = roles.select("*", F.inline(here).alias("to", "words", "mark"))
    body = F.when(~numbered, F.struct("line_no", "kind"))
    own = F.when(numbered, F.struct("line_no", "page", "kind", "num", "own_w", "own_e", "raw_w", "raw_e"))
    by_mark = pieces.groupBy("exam_id", "span", "to", "mark").agg(
        F.sum("words").alias("words"), F.max(F.when((F.col("to") == "head") & (F.col("raw_w") > 0), F.struct("line_no", "raw_e"))).alias("end"),
        F.min(body).alias("after"), F.max("opt").alias("opt"), F.max(own).alias("own"), F.max("shared_line").alias("shared_line"), F.max("line_no").alias("last_line"))
    is_ = lambda x: F.col("to") == x
    by_span = by_mark.groupBy("exam_id", "span").agg(
        F.max("own").alias("own"), F.min("after").alias("after"), F.max("opt").alias("opt"), F.max("end").alias("end"),
        F.coalesce(F.sum(F.when(is_("head"), F.col("words"))), F.lit(0)).cast("int").alias("head_w"),
        *[F.max(F.when(is_(x), F.struct("mark", "words"))).alias(f"set_{x}") for x in LETTERS],
        F.max("shared_line").alias("shared_line"), F.max("last_line").alias("last_line"))
    if pages is None:
        seen = by_span.withColumn("_img", F.lit(False))
    else:
        img = pages.filter("has_images").select("exam_id", F.col("page").alias("_page"), F.lit(True).alias("_img"))
        seen = by_span.withColumn("_page", F.col("own.page")).join(img.hint("merge"), ["exam_id", "_page"], "left")
    return seen.select(
        "exam_id", "span", "own.line_no", "own.page", F.coalesce("_img", F.lit(False)).alias("img"), "own.kind", "own.num",
        "own.own_w", "own.own_e", "own.raw_w", "own.raw_e", F.col("after.kind").alias("after"),
        "head_w", F.col("end.raw_e").alias("head_e"), F.array(*[F.col(f"set_{x}.words").cast("int") for x in LETTERS]).alias("set"),
        (F.ascii("opt.letter") - 64).alias("tail"), "shared_line", "last_line")


def sequence_gate(classified: DataFrame, allow_reset: bool = False, pages: DataFrame | None = None, cfg: Parser = PARSER) -> DataFrame:
    """D3: numbered lines with the verdict of the sequence gate.

    A number is measured against the last confirmed question before the open one.
    """
    scan = scan_numbers(number_spans(classified, pages, cfg), allow_reset, cfg)
    return scan.seen.drop("skip_of")


def drop_weak_lead_block(scan: Scan) -> DataFrame:
    """Every numbered item with its verdict; items of a weak first block that a
    restart at 1 follows are rolled back, and so is the one that was open then."""
    return scan.items.withColumn(
        "status", F.when(F.col("confirmed"), "real_question_confirmed").otherwise("instruction_block")).drop("confirmed")


# --- segments --------------------------------------------------------------


def segment_questions(
    classified: DataFrame, scan: Scan, confirmed_only: bool = False, cfg: Parser = PARSER, items: bool = True,
) -> DataFrame:
    """Item and role (stem or option letter) of every line that belongs to one.

    Lines from the first shared-text lead to the first question have ``num`` -1. ``mark``
    orders the option markers: a repeated marker replaces what its letter had. Lines meet
    their item by range of line numbers, so a long exam is many tasks. The rows of items by block are as many
    as the line numbers have blocks, which no estimate of sizes sees: they are merged, never sent whole to every task.
    Without ``items`` only the lines with ``num`` -1 are met: they end before the first item, and no item changes them.
    """
    wanted = scan.items.where("confirmed") if confirmed_only else scan.items
    spans = wanted.select("exam_id", "num", F.col("page").alias("item_page"), F.col("line").alias("item_line"), "end_line")
    first = scan.exams.join(scan.items.groupBy("exam_id").agg(F.min("line").alias("first")).hint("merge"), "exam_id", "left").withColumn("first", F.coalesce("first", F.lit(END)))
    shared = first.where("shared_line < first").select(
        "exam_id", F.lit(-1).alias("num"), F.lit(None).cast("int").alias("item_page"), F.col("shared_line").alias("item_line"), F.col("first").alias("end_line"))
    last = F.least(F.col("end_line") - 1, F.col("last_line"))
    rows = (spans.unionByName(shared) if items else shared).join(scan.exams.select("exam_id", "last_line").hint("merge"), "exam_id").select(
        "exam_id", "num", "item_page", "item_line", "end_line",
        F.explode(F.sequence(F.expr(f"item_line div {cfg.block_lines}"), F.floor(last / cfg.block_lines))).alias("_block"))
    skip = scan.seen.where("skip_of is not null").select("exam_id", F.col("skip_of").alias("item_line"), F.expr(f"cast(line_no as bigint) div {cfg.block_lines}").alias("_block"), "line_no")
    # The lines that are left out of an item come with its row of the block, so that no text is shuffled for them.
    rows = rows.join(skip.groupBy("exam_id", "item_line", "_block").agg(F.collect_set("line_no").alias("_skips")).hint("merge"), ["exam_id", "item_line", "_block"], "left")
    lines = _in_blocks(classified.drop("num", "page"), cfg)
    met = lines.join(rows.hint("merge"), ["exam_id", "_block"]).filter("line_no >= item_line and line_no < end_line")
    w = Window.partitionBy("exam_id", "item_line").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    option = (F.col("kind") == "option") & (F.col("num") >= 0)
    roles = met.withColumn("opt", F.last(F.when(option, F.struct("line_no", "letter")), ignorenulls=True).over(w))
    start = (F.col("line_no") == F.col("item_line")) & (F.col("num") >= 0)
    numbered = F.col("kind").isin("alone", "start")
    dropped = (
        (~start & (F.col("kind") == "alone") & F.col("opt").isNotNull()) | F.coalesce(F.array_contains("_skips", F.col("line_no")), F.lit(False))
        | ((F.col("num") < 0) & numbered))
    return roles.filter(~dropped).select(
        "exam_id", "num", F.col("item_page").alias("page"), "item_line", "line_no", start.alias("is_start"), "kind", "letter",
        F.when(F.col("num") >= 0, F.coalesce("opt.letter", F.lit("stem"))).alias("role"),
        F.coalesce(F.col("opt.line_no").cast("bigint") * 16 + _FIRST, F.lit(0)).alias("mark"), "first", "last",
        F.when(start | option, F.col("rest")).otherwise(F.col("text")).alias("text"))


def _joined_text(condition: str) -> str:
    pieces = f"array_join(transform(filter(ps, p -> {condition}), p -> p.text), ' ')"
    return f"btrim({pieces}, '{_SPACES_SQL}')"


_SPACES_SQL = "".join(f"\\u{ord(c):04x}" for c in SPACES)


def assemble_questions(segments: DataFrame) -> DataFrame:
    """One row per item, and per shared text (``num`` -1)."""
    is_opt = "(num >= 0 and kind = 'option')"
    pieces = segments.withColumn("parts", F.when(F.expr(is_opt), _inline(F.col("text"))).otherwise(F.array("text")))
    grouped = (
        pieces.selectExpr("*", "posexplode(parts) as (k, part)")
        .groupBy("exam_id", "item_line", "num")
        .agg(
            F.expr(f"""array_sort(collect_list(struct(line_no, k,
              case when k > 0 then substring(part, 1, 1) when {is_opt} then letter else coalesce(role, 'stem') end as role,
              if({is_opt}, cast(line_no as bigint) * 16 + if(k = 0, {_FIRST}, k), mark) as mark,
              case when k > 0 then btrim(substring(part, 2), '{_SPACES_SQL}') when {is_opt} then btrim(part, '{_SPACES_SQL}')
               else part end as text)))""").alias("ps"),
            F.expr("max(page)").alias("page"),
            F.expr("min(line_no)").alias("first_line"),
            F.expr("min(if(kind = 'range', struct(line_no, first, last), null))").alias("rng"),
        )
    )
    newest = [f"array_max(transform(filter(ps, p -> p.role = '{x}'), p -> p.mark)) top_{x}" for x in LETTERS]
    return grouped.selectExpr("*", *newest).selectExpr(
        "exam_id", "item_line", "num", "page", "first_line", "rng.first first", "rng.last last",
        _joined_text("p.role = 'stem'") + " text",
        *[_joined_text(f"p.role = '{x}' and p.mark = top_{x}") + f" {x.lower()}" for x in LETTERS],
    )


def shared_texts(assembled: DataFrame) -> DataFrame:
    """Base texts printed before the first question, with their question range."""
    named = F.when(F.col("first").isNotNull(), F.concat_ws("-", F.lit("shared"), "first", "last"))
    return assembled.filter("num = -1").select(
        "exam_id",
        named.otherwise(F.concat(F.lit("shared-pre-"), F.col("first_line"))).alias("shared_id"),
        "text", "first", "last",
    )


def attach_shared_text(questions: DataFrame, shared: DataFrame) -> DataFrame:
    """The shared text whose range covers the question; the join key is the exam."""
    s = shared.select(
        "exam_id", "shared_id", F.col("text").alias("context_text"),
        F.col("first").alias("_first"), F.col("last").alias("_last"),
    )
    q = questions
    covers = (q.exam_id == s.exam_id) & q.num.between(s._first, s._last)
    return q.join(s.hint("merge"), covers, "left").select(*[q[c] for c in q.columns], "shared_id", "context_text")


def flag_requires_source(questions: DataFrame, pages: DataFrame, cfg: Parser = PARSER) -> DataFrame:
    """Short stem on a page with images."""
    img = pages.filter("has_images").select("exam_id", "page", F.lit(True).alias("_img"))
    return questions.join(img.hint("merge"), ["exam_id", "page"], "left").select(
        *questions.columns,
        (F.coalesce("_img", F.lit(False)) & (word_count(F.col("text")) < cfg.source_stem_words)).alias("requires_source"),
    )


def confidence_score(questions: DataFrame) -> DataFrame:
    """Score 0-100 with the reasons for what is missing."""
    cols = [x.lower() for x in LETTERS]
    words = questions.select(
        "*", word_count(F.col("text")).alias("stem_words"), *[word_count(F.col(c)).alias(f"_w{c}") for c in cols])
    plus = lambda terms: " + ".join(f"cast({t} as int)" for t in terms)
    counted = words.selectExpr(
        "*",
        plus(f"{c} <> ''" for c in cols) + " _present",
        plus(f"({c} <> '' and _w{c} >= {OPTION_WORDS})" for c in cols) + " _good",
        plus(f"(_w{c} >= 2)" for c in cols) + " useful_options",
        "stem_words > 5 and not regexp_like(text, '[.?!:;]$') _cut",
    )
    score = (
        f"if(stem_words >= {STEM_WORDS}, {STEM_POINTS}, 0) + _present * {OPTION_POINTS}"
        f" + if(_good = 5, {OPTION_WORDS_POINTS}, 0) - if(requires_source, {SOURCE_PENALTY}, 0)"
        f" - if(_cut, {TRUNCATED_PENALTY}, 0) - (5 - _present) * {MISSING_PENALTY}"
    )
    # Texts of the reasons.
    reasons = ", ".join([
        f"if(stem_words < {STEM_WORDS}, concat('enunciado curto (', stem_words, ' palavras)'), null)",
        *[f"if({x.lower()} = '', 'alternativa {x} vazia', null)" for x in LETTERS],
        "if(_good < 3, 'alternativas com poucas palavras', null)",
        "if(requires_source, 'requer PDF (imagem detectada)', null)",
        "if(_cut, 'enunciado pode estar truncado', null)",
    ])
    return counted.selectExpr(
        *questions.columns,
        f"cast(greatest(0, least(100, {score})) as int) score",
        f"array_compact(array({reasons})) details",
        "stem_words", "useful_options",
    )


def confirm_questions(scored: DataFrame, cfg: Parser = PARSER) -> DataFrame:
    """Real questions and the numbered text that only looked like one."""
    ok = (
        (F.col("stem_words") >= cfg.min_stem_words)
        & (F.col("useful_options") >= cfg.min_useful_options)
        & (F.col("score") >= cfg.min_score)
    )
    return scored.withColumn("status", F.when(ok, "real_question_confirmed").otherwise("instruction_block"))


def _in_blocks(classified: DataFrame, cfg: Parser) -> DataFrame:
    """Lines with the block in which they meet their items; lines that are stored by it keep their place."""
    stored = f"_block_{cfg.block_lines}"
    if stored in classified.columns:
        return classified.withColumnRenamed(stored, "_block")
    return classified.withColumn("_block", F.expr(f"cast(line_no as bigint) div {cfg.block_lines}"))


def read_numbers(lines: DataFrame, pages: DataFrame | None = None, cfg: Parser = PARSER) -> tuple[DataFrame, Scan]:
    """The labelled lines and the scan of their numbers.

    The lines are labelled once and stored by (exam, block), where they meet their items later; what is left of a line
    without its mark is stored for the lines that have one.
    """
    marked = F.col("kind").isin("alone", "start", "option")
    labelled = _in_blocks(classify_lines(strip_scratch(lines)), cfg).withColumnRenamed("_block", f"_block_{cfg.block_lines}")
    narrow = labelled.withColumn("rest", F.when(marked, F.col("rest")))
    classified = materialize(narrow, "classified", ["exam_id", f"_block_{cfg.block_lines}"]).withColumn("rest", F.coalesce("rest", "text"))
    return classified, scan_numbers(number_spans(classified, pages, cfg), True, cfg)


def parse_questions(
    lines: DataFrame, pages: DataFrame | None = None, cfg: Parser = PARSER, read: tuple[DataFrame, Scan] | None = None,
) -> DataFrame:
    """Confirmed questions with their text, score and shared text; ``read`` are the numbers of the lines where they were read before."""
    classified, scan = read or read_numbers(lines, pages, cfg)
    assembled = assemble_questions(segment_questions(classified, scan, True, cfg))
    # One shared text for an exam: it rides along the exam's confirmed questions, of which there are 99 at most.
    w = Window.partitionBy("exam_id")
    named = F.when(F.col("first").isNotNull(), F.concat_ws("-", F.lit("shared"), "first", "last")).otherwise(
        F.concat(F.lit("shared-pre-"), F.col("first_line")))
    base = F.max(F.when(F.col("num") == -1, F.struct("first", "last", named.alias("id"), F.col("text").alias("text")))).over(w)
    covered = F.col("num").between(F.col("_s")["first"], F.col("_s")["last"])
    items = assembled.withColumn("_s", base).filter("num >= 0").select(
        "exam_id", "num", "page", "text", *[x.lower() for x in LETTERS],
        F.when(covered, F.col("_s")["id"]).alias("shared_id"), F.when(covered, F.col("_s")["text"]).alias("context_text"),
    )
    flagged = items.withColumn("requires_source", F.lit(False)) if pages is None else flag_requires_source(items, pages, cfg)
    return confidence_score(flagged)


def parsing_log(segments: DataFrame, candidates: DataFrame, questions: DataFrame, shared: DataFrame) -> DataFrame:
    """One row per event of the parse, from all items, their verdicts, the confirmed questions and the shared texts."""
    num = F.col("num")
    verdicts = candidates.select(
        "exam_id", F.col("status").alias("event"), num.alias("num"),
        F.concat(F.lit("stem="), "stem_words", F.lit(" useful="), "useful_options", F.lit(" score="), "score").alias("detail"),
    )
    confirmed = candidates.filter("status = 'real_question_confirmed'")
    back = candidates.filter("rolled_back")
    taken = back.groupBy("exam_id").agg(F.min("num").alias("a"), F.max("num").alias("z"), F.count("*").alias("n"))
    resets = taken.select("exam_id", F.lit("sequence_reset").alias("event"), F.lit(1).alias("num"), F.concat_ws("-", "a", "z").alias("detail"))
    rollbacks = taken.select("exam_id", F.lit("rollback").alias("event"), F.lit(1).alias("num"), F.col("n").cast("string").alias("detail"))
    gaps = F.array_compact(F.array(*[F.when(F.col(x.lower()) == "", F.lit(x)) for x in LETTERS]))
    missing = questions.filter(F.size(gaps) > 0).select(
        "exam_id", F.lit("missing_options").alias("event"), num, F.array_join(gaps, ", ").alias("detail")
    )
    source = candidates.filter("requires_source").select(
        "exam_id", F.lit("requires_source").alias("event"), num, F.lit(None).cast("string").alias("detail")
    )
    texts = shared.filter("first is not null").select(
        "exam_id", F.lit("shared_text").alias("event"), F.lit(None).cast("int").alias("num"),
        F.concat_ws("-", "first", "last").alias("detail"),
    )
    # An option marker that neither follows its predecessor nor starts over.
    by_line = Window.partitionBy("exam_id", "item_line").orderBy("line_no")
    marks = segments.filter("num >= 0 and kind = 'option'").withColumn(
        "_prev", F.lag("role").over(by_line)
    )
    rank = lambda c: F.ascii(c) - F.lit(64)
    jumps = marks.filter(
        F.col("_prev").isNotNull() & (F.col("letter") != "A") & (rank(F.col("letter")) != rank(F.col("_prev")) + 1)
    ).select("exam_id", F.lit("option_out_of_sequence").alias("event"), num, F.col("letter").alias("detail"))
    totals = confirmed.groupBy("exam_id").agg(F.count("*").alias("n")).select(
        "exam_id", F.lit("total").alias("event"), F.lit(None).cast("int").alias("num"), F.col("n").cast("string").alias("detail")
    )
    return verdicts.unionByName(missing).unionByName(source).unionByName(texts).unionByName(jumps).unionByName(totals).unionByName(resets).unionByName(rollbacks)
