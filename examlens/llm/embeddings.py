"""Embedding near-duplicates by counting collisions of projections.

Every vector has a value on each of many one-dimensional projections. The projections are
sums of a Gaussian direction of the first and one of the second half of the rotated space, so
k directions for each half give k * k projections for the price of 2k. A vector stands in the
sorted lists of the projections on which it lies farthest out; a window around its value
there holds the vectors it collides with. Pairs that collide on `collisions` projections are
verified by cosine. k grows with the root of the number of vectors, so lists stay short;
`lists` and `collisions` are calibrated on pairs made to lie exactly at the threshold, for each
length of vectors by itself. Short vectors have too few directions for long k: where no number
of lists reaches the recall, all vectors of that length are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled, stage
from .components import components


@dataclass(frozen=True)
class CollisionSpec:
    cosine: float = 0.9
    list_length: int = 1  # vectors in a sorted list, on average
    lists: int = 32  # lists that a vector stands in; doubled until the calibration is met
    most_lists: int = 512  # a length that needs more is compared in blocks
    recall: float = 0.99  # of pairs exactly at the threshold
    window: float = 2.5  # half-width, in standard deviations of the difference at the threshold
    sample: int = 1024  # vectors of a length that its calibration starts from
    few: int = 256  # a length with fewer vectors is compared in one block
    seed: int = 7


@dataclass(frozen=True)
class Projections:
    k: int
    lists: int
    seed: int

    @property
    def rows(self) -> int:
        """Vectors placed at once, so that lists * lists sums of each fit into a few tens of MB."""
        return int(np.clip((1 << 21) // self.lists**2, 4, 2048))

    def directions(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Of one length each: a longer direction would draw more vectors into its lists."""
        rng = np.random.default_rng([self.seed, dim])
        turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        half = max(1, dim // 2)
        one, two = (rng.standard_normal((n, self.k)) for n in (half, dim - half))
        one, two = (d * np.sqrt(len(d)) / np.maximum(np.linalg.norm(d, axis=0), 1e-12) for d in (one, two))
        return turn[:, :half] @ one, turn[:, half:] @ two

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For unit rows: the numbers of the projections on which each lies farthest out, and its values there."""
        one, two = (x @ d for d in self.directions(x.shape[1]))
        u = min(self.lists, self.k)
        i, j = (np.argpartition(-s, u - 1, axis=1)[:, :u] if u < self.k else np.tile(np.arange(self.k), (len(x), 1)) for s in (one, two))
        rows = np.arange(len(x))[:, None]
        sums = (one[rows, i][:, :, None] + two[rows, j][:, None, :]).reshape(len(x), -1)
        number = (i[:, :, None].astype(np.int64) * self.k + j[:, None, :]).reshape(len(x), -1)
        t = min(self.lists, sums.shape[1])
        best = np.argpartition(-sums, t - 1, axis=1)[:, :t] if t < sums.shape[1] else np.tile(np.arange(t), (len(x), 1))
        return number[rows, best], sums[rows, best]


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.to_list(), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


BLOCK = 2048  # vectors of a side of a block


def half_width(spec: CollisionSpec) -> float:
    return spec.window * float(np.sqrt(2 - 2 * spec.cosine))


def calibrated(sample: np.ndarray, vectors: int, spec: CollisionSpec) -> tuple[Projections, int] | None:
    """The projections, and the most collisions that all but 1 - recall of pairs at the threshold reach; None if no number of lists does."""
    rng = np.random.default_rng(spec.seed)
    sample = np.resize(sample, (max(len(sample), spec.sample), sample.shape[1]))  # a small sample is turned to several others each
    other = rng.standard_normal(sample.shape)
    other -= (other * sample).sum(axis=1, keepdims=True) * sample
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-12)
    pair = spec.cosine * sample + np.sqrt(1 - spec.cosine**2) * other
    k = 1 << max(3, round(np.log2(max(vectors * spec.lists / spec.list_length, 1)) / 2))
    lists, width = spec.lists, half_width(spec)
    while True:
        made, hits = Projections(min(k, 1 << 14), lists, spec.seed), []
        for at in range(0, len(sample), made.rows):
            (da, va), (db, vb) = made.lists_of(sample[at : at + made.rows]), made.lists_of(pair[at : at + made.rows])
            hits.append(((da[:, :, None] == db[:, None, :]) & (np.abs(va[:, :, None] - vb[:, None, :]) <= width)).sum(axis=(1, 2)))
        count = int(np.quantile(np.concatenate(hits), 1 - spec.recall, method="lower"))
        if count >= 1:
            return made, count
        if lists >= min(spec.most_lists, k * k):
            return None
        lists *= 2


def near_vectors(vectors: DataFrame, spec: CollisionSpec = CollisionSpec()) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding).

    - vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and stay;
    - vectors with different numbers of components don't link;
    - equal vectors are one class and compared once; each is a link of the others;
    - a null vec_id has a null component unless a link leads to an id; kept is then false;
    - an empty table gives an empty result; other columns are ignored.
    """
    plain = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))  # -0 is 0
    rows = vectors.select("vec_id", plain.alias("embedding"))
    finite = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False))
    valid = finite & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = stage(rows.withColumn("embedding", F.when(valid, F.col("embedding"))).withColumn("vec", F.xxhash64("embedding")), "rows")
    classes = stage(
        rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("members"))
        .withColumn("vec", F.xxhash64("embedding")).withColumn("dim", F.size("embedding")), "classes",
    )
    found = stage(pairs(classes, spec), "pairs")
    both = found.select("a", "b").union(found.select("b", "a"))
    mates = classes.select(F.col("vec").alias("b"), "members")
    n_links = both.join(mates, "b").groupBy(F.col("a").alias("vec")).agg(F.sum("members").alias("others"))
    roots = stage(components(found).withColumnRenamed("node", "vec").join(classes.select("vec", "low"), "vec"), "roots")
    lowest = stage(roots.groupBy("root").agg(F.min("low").alias("reached")), "lowest")
    known = stage(
        classes.select("vec", "members", "low").join(n_links, "vec", "left").join(roots.join(lowest, "root").select("vec", "reached"), "vec", "left")
        .select("vec", (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("reached", "low").alias("component_id")), "known",
    )
    own = F.when(F.col("embedding").isNull(), F.col("vec_id"))
    component = F.coalesce(own, "component_id")
    return rows.join(known, "vec", "left").select(
        "vec_id", F.when(F.col("embedding").isNull(), 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def pairs(classes: DataFrame, spec: CollisionSpec) -> DataFrame:
    """(a, b): vec of two different vectors (vec, embedding, dim) with a cosine at the threshold or above."""
    lists: dict[int, tuple[Projections, int]] = {}
    blocks: dict[int, int] = {}
    for dim, n in sorted((r["dim"], r["count"]) for r in classes.groupBy("dim").count().collect()):  # a row for each length
        made = None
        if n >= spec.few:
            own = classes.where(F.col("dim") == dim)
            sample = sampled(own, F.col("vec"), n, spec.sample).select("embedding").limit(2 * spec.sample).toPandas()["embedding"]
            made = calibrated(unit(sample), n, spec) if len(sample) else None
        if made:
            lists[dim] = made
        elif n > 1:
            blocks[dim] = -(-n // BLOCK)
    found = [f(classes, of, spec) for f, of in ((collided, lists), (compared, blocks)) if of]
    if not found:
        return classes.select(F.col("vec").alias("a"), F.col("vec").alias("b")).limit(0)
    return found[0].union(found[1]) if len(found) > 1 else found[0]


def by_dim(numbers: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in numbers.items() for x in item]), F.col("dim"))


def compared(classes: DataFrame, blocks: dict[int, int], spec: CollisionSpec) -> DataFrame:
    """The pairs among all vectors of the lengths in `blocks`: each of a length's blocks meets itself and every other."""
    rows = classes.where(F.col("dim").isin(list(blocks))).select("dim", "vec", "embedding", by_dim(blocks).alias("of"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("vec", F.lit("block")), F.col("of")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    rows = rows.select("dim", "vec", "embedding", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        a, b = rows[rows["own"] == i], rows[rows["own"] == j]
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if not len(a) or not len(b):
            return none
        x, y = unit(a["embedding"]), unit(b["embedding"])
        va, vb, out = a["vec"].to_numpy(), b["vec"].to_numpy(), [none]
        for at in range(0, len(x), 512):
            p, q = np.nonzero(x[at : at + 512] @ y.T >= spec.cosine - 1e-9)
            p += at
            if i == j:
                p, q = p[va[p] < vb[q]], q[va[p] < vb[q]]
            ea, eb = (np.array(e.iloc[w].to_list(), dtype=np.float64).reshape(len(w), -1) for e, w in ((a["embedding"], p), (b["embedding"], q)))
            near = cosines(ea, eb) >= spec.cosine
            m, n = va[p[near]], vb[q[near]]
            out.append(pd.DataFrame({"a": np.minimum(m, n), "b": np.maximum(m, n)}))
        return pd.concat(out)

    return rows.groupBy("dim", "i", "j").applyInPandas(compare, "a long, b long")


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def collided(classes: DataFrame, lists: dict[int, tuple[Projections, int]], spec: CollisionSpec) -> DataFrame:
    """The pairs of the lengths in `lists` that collide often enough, verified."""
    classes = classes.where(F.col("dim").isin(list(lists)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, b in batch.groupby("dim"):
                made = lists[int(dim)][0]
                for k in range(0, len(b), made.rows):
                    part = b.iloc[k : k + made.rows]
                    number, value = made.lists_of(unit(part["embedding"]))
                    per = number.shape[1]
                    yield pd.DataFrame({"dim": int(dim), "list": number.ravel().astype(np.int32), "value": value.ravel().astype(np.float32), "vec": np.repeat(part["vec"].to_numpy(), per)})

    placed = stage(classes.select("vec", "embedding", "dim").mapInPandas(place, "dim int, list int, value float, vec long"), "placed")
    width = half_width(spec)
    met = placed.alias("p").join(placed.alias("q"), ["dim", "list"]).where((F.col("p.vec") < F.col("q.vec")) & (F.abs(F.col("p.value") - F.col("q.value")) <= width))
    counted = met.groupBy(F.col("p.vec").alias("a"), F.col("q.vec").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("p.dim").alias("dim"))
    often = counted.where(F.col("n") >= by_dim({dim: count for dim, (_, count) in lists.items()}))
    of = lambda name: classes.select(F.col("vec").alias(name), F.col("embedding").alias(f"e{name}"))
    laid = often.select("a", "b").join(of("a"), "a").join(of("b"), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, p in batch.groupby(batch["ea"].map(len)):
                x, y = (np.array(p[c].to_list(), dtype=np.float64) for c in ("ea", "eb"))
                yield p.loc[cosines(x, y) >= spec.cosine, ["a", "b"]]

    return laid.mapInPandas(verify, "a long, b long")
