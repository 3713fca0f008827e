"""Which numbers open questions, as a scan that carries a small state along the numbered lines.

Rows are read in the order of lines; items and verdicts go out as rows as soon as they are known,
and only the open item, the last unbroken run and a few numbers are kept. An exam of many lines is
cut into blocks of numbered lines that run in tasks of their own. A block first runs as if it were the exam's beginning;
then the state at a block's end is handed to the next one, and blocks that were entered otherwise
run again, until every entry is the end of the block before. Words added to an open item and counts of
items are sums, so an entry that differs in them alone changes the end by the difference. A number is
only accepted above the last confirmed one, which has two digits, so few rounds are needed; the result
does not depend on the cuts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlens.config import PARSER, Parser
from examlens.sources.sinks import materialize

# Points of the confidence score.
STEM_WORDS, STEM_POINTS = 10, 30
OPTION_POINTS, OPTION_WORDS, OPTION_WORDS_POINTS = 15, 3, 10
SOURCE_PENALTY, TRUNCATED_PENALTY, MISSING_PENALTY = 20, 15, 10
END = 2**31 - 1

ROW = (
    "exam_id bigint, block bigint, what string, num int, page int, line int, end_line int, score int, stem_words int, useful_options int, "
    "requires_source boolean, confirmed boolean, forced boolean, place bigint, accepted boolean, skip_of int, shared_line int, last_line int, state string"
)
_ARROW = pa.schema([
    ("exam_id", pa.int64()), ("block", pa.int64()), ("what", pa.string()), *[(c, pa.int32()) for c in ("num", "page", "line", "end_line", "score", "stem_words", "useful_options")],
    *[(c, pa.bool_()) for c in ("requires_source", "confirmed", "forced")], ("place", pa.int64()), ("accepted", pa.bool_()),
    *[(c, pa.int32()) for c in ("skip_of", "shared_line", "last_line")], ("state", pa.string()),
])


@dataclass
class Reader:
    """The state between two numbered lines, and the rules for the next one."""

    last: int = -1  # the last confirmed number
    on: bool = False  # an item is open: its number, page, image flag, first line, words, ending, option words, role
    num: int = -1
    page: int | None = -1
    img: bool = False
    line: int = -1
    words: int = 0
    ended: bool | None = False
    options: list[int] = field(default_factory=lambda: [0] * 5)
    role: int = 0
    run: list = field(default_factory=lambda: [-1, -1, 0, 0, 0, False])  # the last unbroken run of confirmed items: first, last, items, points, useful options, is it the first run
    confirmed: int = 0
    forced: int = -1  # the open item of this number will be discarded
    wait: list | None = None  # a bare number that waits for its text: number, page, image flag
    wait_line: int = -1
    filed: int = 0
    kept: list | None = None  # since the block began the same item is open; for each option, words were only added

    def close(self, end: int, cfg: Parser) -> dict:
        """The open item judged; it ends before line ``end``."""
        filled, good, useful = (sum(w >= n for w in self.options) for n in (1, OPTION_WORDS, 2))
        source = self.img and self.words < cfg.source_stem_words
        score = STEM_POINTS * (self.words >= STEM_WORDS) + filled * OPTION_POINTS + OPTION_WORDS_POINTS * (good == 5)
        score -= SOURCE_PENALTY * source + TRUNCATED_PENALTY * (self.words > 5 and self.ended is False) + (5 - filled) * MISSING_PENALTY
        score, forced = max(0, min(100, score)), self.forced == self.num
        ok = self.words >= cfg.min_stem_words and useful >= cfg.min_useful_options and score >= cfg.min_score and not forced
        row = dict(
            what="item", num=self.num, page=self.page, line=self.line, end_line=end, score=score, stem_words=self.words, useful_options=useful,
            requires_source=source, confirmed=ok, forced=forced, place=self.filed)
        self.filed, self.on, self.kept = self.filed + 1, False, None
        if forced:
            self.forced = -1
        if ok:
            first, before, items, points, options, is_first = self.run
            if items and self.num == before + 1:
                self.run = [first, self.num, items + 1, points + score, options + useful, is_first]
            else:
                self.run = [self.num, self.num, 1, score, useful, self.confirmed == 0]
            self.last, self.confirmed = self.num, self.confirmed + 1
        return row

    def read(self, c: dict, allow_reset: bool, cfg: Parser) -> Iterator[dict]:
        """What a numbered line means, the text of a refused one added to the open item, and the lines up to the next number."""
        bare, waits = c["kind"] == "alone", self.wait is not None
        as_text = waits and not bare  # the first line after an accepted bare number is its text
        forward = c["num"] <= cfg.max_first_number if self.last < 0 else self.last < c["num"] <= self.last + cfg.max_jump
        first, before, items, points, options, is_first = self.run
        weak = items >= cfg.weak_min_items and is_first and (points <= items * cfg.weak_max_score or options <= items * cfg.weak_max_useful)
        reset = not as_text and allow_reset and not forward and self.last >= 0 and c["num"] == 1 and weak
        taken = not as_text and (forward or reset)
        if self.on and not taken and not as_text and (not bare or (self.role == 0 and not waits)):
            if self.role:
                self.options[self.role - 1] += c["raw_w"]
            else:
                self.words += c["raw_w"]
                self.ended = c["raw_e"] if c["raw_w"] > 0 else self.ended
        if reset:
            if self.on and first <= self.num <= before + 1:
                self.forced = self.num
            self.last, self.confirmed, self.run[2] = -1, 0, 0
            yield dict(what="reset", place=self.filed)
        mine = bare and taken
        yield dict(what="seen", num=c["num"], page=c["page"], line=c["line_no"], accepted=taken, skip_of=self.line if mine and self.on else None)
        if mine:
            self.wait = [c["num"], c["page"], c["img"]]
        if bare and (taken or waits):
            self.wait_line = c["line_no"]
        held = bare and (taken or waits)
        direct = taken and not bare
        opens = as_text or direct or (held and c["after"] is not None and c["after"] != "option")
        if opens:
            start = c["line_no"] if direct else self.wait_line
            if self.on:
                yield self.close(start, cfg)
            self.num, self.page, self.img = (c["num"], c["page"], c["img"]) if direct else self.wait
            self.on, self.line, self.options, self.role = True, start, [0] * 5, 0
            self.words, self.ended = (c["own_w"], c["own_e"]) if direct else (c["raw_w"], c["raw_e"]) if as_text else (0, False)
        if not (held and c["after"] is None) and (opens or bare):
            self.wait = None
        if self.on:
            if self.role == 0:
                self.words += c["head_w"]
                self.ended = self.ended if c["head_e"] is None else c["head_e"]
            for i, w in enumerate(c["set"]):
                if w is not None:
                    self.options[i] = w
                    if self.kept:
                        self.kept[i] = False
                elif self.role == i + 1:
                    self.options[i] += c["head_w"]
            self.role = self.role if c["tail"] is None else c["tail"]

    def dump(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def load(cls, text: str | None) -> Reader:
        """A state at the beginning of a block."""
        reader = cls(**json.loads(text)) if text else cls()
        reader.kept = [True] * 5 if reader.on else None
        return reader


def shifted(end: str, ran: str | None, now: str | None) -> str | None:
    """The end of a block that ran from `ran`, for the entry `now`; None if it takes a run to know."""
    a, b = Reader.load(ran).__dict__, Reader.load(now).__dict__
    differ = {k for k in a if a[k] != b[k]}
    e = json.loads(end)
    if not differ <= ({"filed", "words", "options"} if e["kept"] else {"filed"}):
        return None
    e["filed"] += b["filed"] - a["filed"]
    if e["kept"]:
        e["words"] += b["words"] - a["words"]
        e["options"] = [w + (y - x) * k for w, x, y, k in zip(e["options"], a["options"], b["options"], e["kept"])]
    return json.dumps(e)


def _run(spans: DataFrame, allow_reset: bool, cfg: Parser, rows: bool) -> DataFrame:
    """Blocks of spans (with ``entry``, the state to start from, and ``final``, is it the exam's last block)
    to items and verdicts, if ``rows``, and a row ``end`` with the state at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader, shared, last, final = None, None, None, None, True
        out: list[dict] = []

        def end() -> None:
            out.append(dict(exam_id=key[0], block=key[1], what="end", shared_line=shared, last_line=last, state=reader.dump()))
            if rows and final and reader.on:
                out.append(dict(zip(("exam_id", "block"), key)) | reader.close(END, cfg))

        for batch in batches:
            for c in batch.to_pylist():
                here = (c["exam_id"], c["block"])
                if here != key:
                    if key is not None:
                        end()
                    key, final, shared, last = here, c["final"], None, None
                    reader = Reader.load(c["entry"])
                if c["shared_line"] is not None:
                    shared = c["shared_line"] if shared is None else max(shared, c["shared_line"])
                if c["last_line"] is not None:
                    last = c["last_line"] if last is None else max(last, c["last_line"])
                if c["kind"] is not None:
                    found = [dict(exam_id=key[0], block=key[1]) | r for r in reader.read(c, allow_reset, cfg)]
                    if rows:
                        out += found
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
            out = []
        if key is not None:
            end()
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    ordered = spans.repartition("exam_id", "block").sortWithinPartitions("exam_id", "block", "span")
    return ordered.mapInArrow(run, ROW)


def _in_blocks(spans: DataFrame, cfg: Parser) -> DataFrame:
    """Spans with their ``block``: ranges of line numbers, put together until they hold ``scan_lines`` spans. What counts is
    how many numbered lines an exam has, not how its lines are numbered; only exams with more of them have a second block."""
    ranged = spans.withColumn("_range", F.greatest(F.expr(f"cast(span as bigint) div {cfg.scan_lines}"), F.lit(0)))
    before = F.sum("_n").over(Window.partitionBy("exam_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counted = ranged.groupBy("exam_id", "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    later = counted.select("exam_id", "_range", F.expr(f"_before div {cfg.scan_lines}").alias("block")).where("block > 0")
    return ranged.join(later, ["exam_id", "_range"], "left").withColumn("block", F.coalesce("block", F.lit(0))).drop("_range")


@dataclass
class Scan:
    """``items``: every numbered item with its span of lines and its verdict; ``seen``: every numbered line with the verdict of
    the gate (``skip_of``: the item whose text it is left out of); ``exams``: first line of a shared text, last line."""

    items: DataFrame
    seen: DataFrame
    exams: DataFrame


def scan_numbers(spans: DataFrame, allow_reset: bool = True, cfg: Parser = PARSER) -> Scan:
    """The scan over ``spans``, a row for each numbered line of an exam with what follows up to the next one."""
    blocks = _in_blocks(materialize(spans, "spans"), cfg)
    plain = blocks.withColumns({"entry": F.lit(None).cast("string"), "final": F.lit(True)})
    found = materialize(_run(plain, allow_reset, cfg, True), "numbers")
    ends = found.where("what = 'end'")
    several = ends.groupBy("exam_id").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select("exam_id")
    if not several.isEmpty():
        several = materialize(several, "several")
        long = blocks.join(several, "exam_id", "left_semi")
        states = _hand_over(long, ends.join(several, "exam_id", "left_semi"), allow_reset, cfg)
        again = _run(long.join(states.select("exam_id", "block", "entry", "final"), ["exam_id", "block"]), allow_reset, cfg, True)
        found = materialize(found.join(several, "exam_id", "left_anti").unionByName(again), "numbers")
    resets = found.where("what = 'reset'").groupBy("exam_id").agg(F.max("place").alias("cut"))
    back = F.col("confirmed") & (F.col("place") < F.coalesce("cut", F.lit(0)))
    # A row of each exam is merged, not broadcast: the file looks small by its compressed size, and exams grow with the input.
    items = found.where("what = 'item'").join(resets.hint("merge"), "exam_id", "left").select(
        "exam_id", "num", "page", "line", "end_line", "score", "stem_words", "useful_options", "requires_source",
        (F.col("confirmed") & ~back).alias("confirmed"), (back | F.col("forced")).alias("rolled_back"))
    seen = found.where("what = 'seen'").select("exam_id", "page", F.col("line").alias("line_no"), "num", "accepted", "skip_of")
    exams = found.where("what = 'end'").groupBy("exam_id").agg(F.max("shared_line").alias("shared_line"), F.max("last_line").alias("last_line"))
    return Scan(items, seen, exams)


def _walk(blocks: pd.DataFrame) -> pd.DataFrame:
    """One exam's blocks, each with the entry and end of its last run: what it is entered with as far as known,
    its end, and whether it must run. Beyond the first block that must, entries are guesses: the end of the block
    before if that ran under the last number that is known now, else the state in which the first is entered."""
    blocks = blocks.sort_values("block")
    now, known, out = None, None, []
    for ran, state in zip(blocks["entry"], blocks["state"]):
        ran = ran if isinstance(ran, str) else None
        end = state if now == ran else shifted(state, ran, now)
        again = end is None
        if again and known is None:
            known = Reader.load(now).__dict__
        elif known is not None and Reader.load(ran).last != known["last"]:
            again = True
        out.append((now, state if end is None else end, again))
        if known is not None and Reader.load(ran).last != known["last"]:
            now = json.dumps(known)
        else:
            now = out[-1][1]
    found = pd.DataFrame(out, columns=["entry", "state", "again"], index=blocks.index).astype({"entry": object, "state": object})
    return pd.concat([blocks[["exam_id", "block"]], found], axis=1).assign(final=blocks["block"] == blocks["block"].max())


def _hand_over(long: DataFrame, ends: DataFrame, allow_reset: bool, cfg: Parser) -> DataFrame:
    """(exam_id, block, entry, final) of the blocks of long exams: each is entered as the one before it ends.
    A group is the blocks of one exam, a short state each."""
    known = ends.select("exam_id", "block", F.lit(None).cast("string").alias("entry"), "state")
    while True:
        walked = materialize(known.groupBy("exam_id").applyInPandas(_walk, "exam_id bigint, block bigint, entry string, state string, again boolean, final boolean"), "states")
        again = walked.where("again")
        if again.isEmpty():
            return walked
        rows = long.join(again.select("exam_id", "block", "entry"), ["exam_id", "block"]).withColumn("final", F.lit(False))
        new = _run(rows, allow_reset, cfg, False).select("exam_id", "block", F.col("state").alias("_state"))
        known = walked.join(new, ["exam_id", "block"], "left").select("exam_id", "block", "entry", F.coalesce("_state", "state").alias("state"))
