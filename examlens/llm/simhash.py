"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints within 2 bits agree, in some part of the bits, up to that part's threshold,
if the thresholds of m parts sum to 2 - m + 1 (-1: the part is not probed). Bits that vary
together share a part, so the other parts stay selective; the number of parts and their
thresholds come from a dynamic program over the candidates and probes that each would cost,
estimated from all fingerprints. Probes meet in an equality join and pairs are verified.

A value that more than `bucket` probes share would cost all pairs of them. Its members are
linked in another exact way: two fingerprints are within 2 bits if and only if some 64-bit
value is within 1 bit of both, so each member names its 65 such values, and those that name
the same one (65 at most) are joined in a star. Links inside such a star are all real, and
the star leaves their component as it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components

RADIUS = 2
BITS = 64


@dataclass(frozen=True)
class SimHashSpec:
    shingle: int = 3
    bucket: int = 64  # a value with more probes takes the way by common neighbours


def simhash(text: str | None, shingle: int) -> int:
    """64 majority bits over the XXH64 (seed 42) of the text's word shingles, repeats included; 0 without words."""
    words = text.encode().lower().split() if text else []  # both on bytes: A-Z and the six white-space characters only
    if not words:
        return 0
    joined, n = b" ".join(words), min(shingle, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: len(words) - n + 1].tolist(), end[n - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, len(first), 1 << 16):
        h = np.array([digest(joined[a:z], 42) for a, z in zip(first[k : k + (1 << 16)], last[k : k + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(first), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    return F.pandas_udf(lambda texts: pd.Series([simhash(t, shingle) for t in texts], dtype="int64"), "long")(text)


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each two bits in how many both are set."""

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, total = n + len(x), total + x.T @ x
        i, j = np.triu_indices(BITS)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(total[i, j], n)})

    rows = prints.select("fp").mapInPandas(gram, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 2,081 rows
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r.i < 0:
            n = int(r.n)
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return n, both


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of equal size; each grows from the strongest pair left by the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    link = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(link, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        rest = link[np.ix_(free, free)]
        group = [free[int(rest.max(axis=1).argmax())]]
        while len(group) < size:
            others = [b for b in free if b not in group]
            group.append(others[int(link[np.ix_(others, group)].sum(axis=1).argmax())])
        out.append(sorted(group))
        free = [b for b in free if b not in group]
    return out


def thresholds(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The cheapest threshold for each part, given each part's cost by threshold, with the sum `total`."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t, c in part.items():
                if s + t not in step or cost + c < step[s + t][0]:
                    step[s + t] = (cost + c, [*chosen, t])
        best = step
    return best.get(total, (math.inf, []))


def mask_of(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def probe_plan(prints: DataFrame) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part to probe, the cheapest of 2, 3 or 4 parts. Counts cover all fingerprints."""
    n, both = bit_counts(prints)
    p = np.diag(both) / max(n, 1)
    differ = np.minimum(2 * p * (1 - p), 0.5)
    ways = {m: grouped_bits(n, both, m) for m in range(2, RADIUS + 3)}
    values = [F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask_of(bits))).alias("v")) for m, groups in ways.items() for k, bits in enumerate(groups)]
    sizes = prints.select(F.explode(F.array(*values)).alias("x")).groupBy("x.m", "x.k", "x.v").count().where("count > 1")
    pairs = {(r.m, r.k): r.pairs for r in sizes.groupBy("m", "k").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}  # 9 rows at most
    found = []
    for m, groups in ways.items():
        costs = []
        for k, bits in enumerate(groups):
            same = pairs.get((m, k), 0.0)
            near = same + (same + n / 2) * sum(differ[b] / (1 - differ[b]) for b in bits)
            costs.append({-1: 0.0, 0: same + n, 1: near + n * (len(bits) + 2)})
        cost, chosen = thresholds(costs, RADIUS - m + 1)
        found.append((cost, m, [(bits, t) for bits, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(found)[2]


def links(prints: DataFrame, spec: SimHashSpec = SimHashSpec()) -> DataFrame:
    """(a, b): links within 2 bits between different fingerprints (fp), enough of them to join every component."""
    plan = probe_plan(prints)
    fp = F.col("fp")
    own, near = [], []
    for k, (bits, t) in enumerate(plan):
        part = lambda x, k=k, bits=bits: F.struct(F.lit(k).alias("part"), x.bitwiseAND(F.lit(mask_of(bits))).alias("value"))
        own.append(part(fp))
        near += [part(fp.bitwiseXOR(F.lit(mask_of([b])))) for b in bits] if t else []
    spread = lambda x: prints.select("fp", F.explode(F.array(*x)).alias("x")).select("x.part", "x.value", "fp")
    index = stage(spread(own), "index")
    probes = stage(spread(own + near), "probes") if near else index
    hot = stage(probes.groupBy("part", "value").count().where(F.col("count") > spec.bucket).select("part", "value"), "hot")
    cold = probes.join(hot, ["part", "value"], "left_anti")
    met = cold.alias("p").join(index.alias("i"), ["part", "value"]).where("p.fp < i.fp").select(F.col("p.fp").alias("a"), F.col("i.fp").alias("b"))
    pairs = met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()

    crowded = probes.join(hot, ["part", "value"], "left_semi").select("fp").distinct()
    around = [fp, *[fp.bitwiseXOR(F.lit(mask_of([b]))) for b in range(BITS)]]
    stars = crowded.select("fp", F.explode(F.array(*around)).alias("near")).groupBy("near").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return pairs.union(stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b"))


def near_duplicates(docs: DataFrame, spec: SimHashSpec = SimHashSpec()) -> DataFrame:
    """doc_id, fp (long) and component_id of every row of `docs`.

    - a null text and one without words have fingerprint 0, and are linked like any other;
    - component_id is the smallest doc_id reachable; ids that are null are never the smallest,
      so a component of rows without ids has a null one; rows with equal ids each keep a row;
    - an empty table gives an empty result; other columns of `docs` are ignored.
    """
    rows = stage(docs.select("doc_id", fingerprint(F.col("text"), spec.shingle).alias("fp")), "prints")
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(prints, spec)).withColumnRenamed("node", "fp")
    linked = stage(prints.join(roots, "fp").select("fp", "root", "low"), "linked")
    lowest = stage(linked.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    member = stage(linked.join(lowest, "root").select("fp", "component_id"), "member")
    every = stage(prints.join(member, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "every")
    return rows.join(every, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, spec: SimHashSpec = SimHashSpec()) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of their group, one row for each; rows without an id all stay."""
    near = near_duplicates(docs, spec)
    keep = near.where("doc_id = component_id").select("doc_id").distinct()
    with_id = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return with_id.select(*docs.columns).union(docs.where("doc_id is null"))
