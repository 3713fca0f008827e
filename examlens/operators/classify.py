"""Classification of questions in budgeted batches around a user-supplied model."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.config import CLASSIFICATION, Classification
from examlens.functions.ordered import position
from examlens.functions.text import trimmed
from examlens.operators.budget import run_days

DIFFICULTIES = ("easy", "medium", "hard")
ITEMS = "items array<struct<index:double,subject:string,topic:string,difficulty:string,cognitive_level:string>>"
INSTRUCTIONS = "Responda em JSON com items: index, subject, topic, difficulty (easy, medium ou hard)."
_ORDER_BLOCK = 64  # question numbers per range when batches are counted


def pending_questions(questions: DataFrame) -> DataFrame:
    """G1: what is still to be classified."""
    return questions.filter("classification_status = 'pending'").select(
        "exam_id", "q_order", "question_id", "question_text", "options")


def make_batches(pending: DataFrame, cfg: Classification = CLASSIFICATION) -> DataFrame:
    """Consecutive batches per exam with the index of each question in its batch."""
    numbered = position(
        pending, ["exam_id"], F.floor(F.col("q_order") / _ORDER_BLOCK), [F.col("q_order"), F.col("question_id")], "_n")
    at = F.col("_n") - 1
    return numbered.select(
        *pending.columns, F.floor(at / cfg.batch_size).cast("int").alias("batch_no"), (at % cfg.batch_size).alias("idx"))


def batch_payload(batches: DataFrame, instructions: str = INSTRUCTIONS) -> DataFrame:
    """One prompt per batch: instructions and a JSON array of at most ten questions."""
    item = F.struct(F.col("idx").alias("index"), F.col("question_text").alias("questionText"), "options")
    listed = F.to_json(F.array_sort(F.collect_list(item)))
    return batches.groupBy("exam_id", "batch_no").agg(
        F.concat_ws("\n\n", F.lit(instructions), listed).alias("prompt"), F.count("*").alias("questions"))


def parse_classifications(responses: DataFrame) -> DataFrame:
    """Valid items of each response, or the reason why there are none.

    An item is valid if it is an object with an integer index, texts that aren't
    blank as subject and topic, and one of the difficulties; others are left out.
    """
    doc = F.try_parse_json("response")
    raw = F.try_variant_get(doc, "$.items", "array<variant>")

    def field(i: Column, name: str) -> Column:
        return F.try_variant_get(i, f"$.{name}", "variant")

    def text(i: Column, name: str) -> Column:
        return F.when(F.schema_of_variant(field(i, name)) == "STRING", trimmed(F.try_variant_get(i, f"$.{name}", "string")))

    def whole(i: Column) -> Column:
        kind, n = F.schema_of_variant(field(i, "index")), F.try_variant_get(i, "$.index", "double")
        return F.when(kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))$") & (n == F.floor(n)) & n.between(-(2**31), 2**31 - 1), n.cast("int"))

    items = F.transform(raw, lambda i: F.struct(
        whole(i).alias("index"), text(i, "subject").alias("subject"), text(i, "topic").alias("topic"),
        F.when(F.schema_of_variant(field(i, "difficulty")) == "STRING", F.try_variant_get(i, "$.difficulty", "string")).alias("difficulty"),
        text(i, "cognitive_level").alias("cognitive_level")))
    valid = F.filter(items, lambda i: i["index"].isNotNull() & (F.length(i["subject"]) > 0) & (F.length(i["topic"]) > 0) & F.coalesce(i["difficulty"].isin(*DIFFICULTIES), F.lit(False)))
    error = F.when(F.col("_doc").isNull(), "CLASSIFICATION_INVALID_JSON").when(
        F.coalesce(F.size("items"), F.lit(0)) < 1, "CLASSIFICATION_INVALID_SCHEMA")
    return responses.withColumns({"_doc": doc, "items": valid}).withColumn("error", error).drop("_doc")


def classification_items(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per valid item with its place in the response."""
    return parsed.filter("error is null").select(*keys, F.posexplode("items").alias("pos", "i")).select(*keys, "pos", "i.*")


def match_classifications(
    batches: DataFrame, items: DataFrame, timed_out: DataFrame, order: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classified, to retry one by one, failed) questions of the batches.

    Items meet questions by batch and index; of several for one question the
    last in ``order`` wins. A batch that timed out fails as a whole.
    """
    key = ["exam_id", "batch_no", "idx"]
    last = items.withColumn("idx", F.col("index")).groupBy(*key).agg(
        F.max_by(F.struct("subject", "topic", "difficulty"), order).alias("c"))
    late = timed_out.select("exam_id", "batch_no")
    alive = batches.join(late, ["exam_id", "batch_no"], "left_anti")
    joined = alive.join(last, key, "left")
    columns = [c for c in batches.columns if c not in ("subject", "topic", "difficulty")]
    classified = joined.filter("c is not null").select(*columns, "c.*")
    retry = joined.filter("c is null").select(*columns)
    failed = batches.join(late, ["exam_id", "batch_no"], "left_semi").select(*columns)
    return classified, retry, failed


def match_retries(retry: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A single retry takes its first item; without one the question fails."""
    first = parsed.filter("error is null").select("question_id", F.get("items", F.lit(0)).alias("i"))
    joined = retry.join(first, "question_id", "left")
    return (
        joined.filter("i is not null").select(*retry.columns, "i.subject", "i.topic", "i.difficulty"),
        joined.filter("i is null").select(*retry.columns),
    )


def usage_cost(usage: DataFrame, cfg: Classification = CLASSIFICATION) -> DataFrame:
    """Tokens and their price in USD."""
    zero = F.lit(0).cast("bigint")
    tokens_in = F.coalesce("prompt_tokens", zero)
    tokens_out = F.coalesce("response_tokens", "candidates_tokens", zero)
    million = 1_000_000
    return usage.withColumns({
        "input_tokens": tokens_in,
        "output_tokens": tokens_out,
        "total_tokens": F.coalesce("total_tokens", tokens_in + tokens_out),
        "cost_usd": tokens_in / million * cfg.input_usd_per_million + tokens_out / million * cfg.output_usd_per_million,
    })


def daily_budget(usage: DataFrame, cfg: Classification = CLASSIFICATION, block: int = 65536) -> DataFrame:
    """Per day, in arrival order ``seq``, batches run while the cost before them is below the limit.

    What does not run is first in the queue of the next day and counts against its limit (see `budget.py`).
    """
    return run_days(usage, cfg.daily_usd, block)


def apply_classifications(questions: DataFrame, patches: DataFrame, failed: DataFrame) -> DataFrame:
    """Classified and failed questions updated, the others untouched."""
    p = patches.select("question_id", *[F.col(c).alias(f"_{c}") for c in ("subject", "topic", "difficulty")], F.lit(True).alias("_ok"))
    bad = failed.select("question_id", F.lit(True).alias("_bad"))
    d = questions.join(p, "question_id", "left").join(bad, "question_id", "left")
    ok = F.coalesce("_ok", F.lit(False))
    new = lambda c: F.when(ok, F.col(f"_{c}")).otherwise(F.col(c) if c in questions.columns else F.lit(None).cast("string"))
    rest = [c for c in questions.columns if c not in ("subject", "topic", "difficulty", "classification_status")]
    status = F.when(ok, "classified").when(F.coalesce("_bad", F.lit(False)), "failed").otherwise(F.col("classification_status"))
    return d.select(*rest, *[new(c).alias(c) for c in ("subject", "topic", "difficulty")], status.alias("classification_status"))


def _valid_item(item: object) -> bool:
    """The rule of ``parse_classifications``."""
    if not isinstance(item, dict):
        return False
    index = item.get("index")
    whole = isinstance(index, (int, float)) and not isinstance(index, bool) and index == index // 1
    return whole and item.get("difficulty") in DIFFICULTIES and all(
        isinstance(item.get(k), str) and item[k].strip() for k in ("subject", "topic"))


def _is_schema_error(response: str | None) -> bool:
    try:
        node = json.loads(response or "")
    except ValueError:
        return True
    items = node.get("items") if isinstance(node, dict) else None
    return not isinstance(items, list) or not any(map(_valid_item, items))


def classify_with(
    payload: DataFrame, fn: Callable[[str], str | tuple[str, int, int]], max_retries: int = CLASSIFICATION.max_retries
) -> DataFrame:
    """The user's model called once per batch, in the tasks that hold the batches.

    ``fn`` returns the response, or it with the tokens of prompt and answer; the
    tokens of all attempts add up. A response without valid items is asked for
    again up to ``max_retries`` times; ``TimeoutError`` gives the batch up, any
    other exception is noted as its error and leaves its questions to single
    retries. Parse the result with G4.
    """

    def call(prompt: str) -> tuple[str | None, bool, int, str | None, int, int]:
        response, spent = None, [0, 0]
        for attempt in range(1, max_retries + 2):
            try:
                answer = fn(prompt)
            except TimeoutError:
                return None, True, attempt, "TIMEOUT", *spent
            except Exception as e:  # the model is the user's: whatever it raises concerns this batch alone
                return None, False, attempt, f"{type(e).__name__}: {e}", *spent
            response, *tokens = answer if isinstance(answer, tuple) else (answer, 0, 0)
            spent = [a + b for a, b in zip(spent, tokens, strict=True)]
            if not _is_schema_error(response):
                break
        return response, False, attempt, None, *spent

    columns = ["response", "timed_out", "attempts", "error", "prompt_tokens", "response_tokens"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame([call(p) for p in f["prompt"]], columns=columns, index=f.index)
            yield pd.concat([f[["exam_id", "batch_no"]], out], axis=1)

    return payload.select("exam_id", "batch_no", "prompt").mapInPandas(
        run, "exam_id bigint, batch_no int, response string, timed_out boolean, attempts int, error string, prompt_tokens bigint, response_tokens bigint")
