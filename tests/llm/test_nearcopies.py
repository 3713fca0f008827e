import random

import numpy as np
from pyspark.sql import functions as F
from tables import docs

from examlens.llm.nearcopies import NearSpec, minhash, shingle_hashes, without_near_copies


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def holds(before, after):
    """Of what stays no two are alike, and what goes is alike to something lower. `before` maps ids to texts."""
    sets = {i: shingles(t) for i, t in before.items()}
    kept = sorted(after)
    assert not [(a, b) for k, a in enumerate(kept) for b in kept[k + 1 :] if alike(sets[a], sets[b])]
    assert all(any(j < i and alike(sets[i], sets[j]) for j in sets) for i in set(before) - set(after))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_keeps_what_brute_force_keeps(spark):
    """Small and large groups at all similarities, shared passages, and buckets of every size."""
    rng, texts = random.Random(3), []
    passage = [f"p{i}" for i in range(60)]
    for group in (2, 3, 5, 40):
        for _ in range(4):
            words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((12, 80, 300)))]
            texts += [edited(rng, words, rng.randrange(1 + len(words) // 20)) for _ in range(group)]
    texts += [" ".join([*passage, *(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 90)))]) for _ in range(40)]
    rng.shuffle(texts)
    before = dict(enumerate(texts))
    df = spark.createDataFrame(list(before.items()), "doc_id long, text string")
    for spec in (NearSpec(), NearSpec(bucket=3, pivots=2)):
        after = {r.doc_id for r in without_near_copies(df, spec).collect()}
        holds(before, after)
        assert len(after) < len(before)


def test_keeps_the_same_whatever_is_crowded(spark):
    """Chains (b alike to a, c alike to b only) keep the same ids for all sizes of band values, and exactly what the rule keeps."""
    rng, texts = random.Random(5), []
    for _ in range(40):
        a = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        b = [*a[18:], *(f"w{rng.randrange(10**6)}" for _ in range(18))]  # 178 of 214 shingles
        c = [*b[18:], *(f"w{rng.randrange(10**6)}" for _ in range(18))]  # 160 of 232 with a
        texts += [" ".join(w) for w in (a, a[:-1], b, c)]
    passage = [f"p{i}" for i in range(120)]
    texts += [" ".join([*passage, *(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 120)))]) for _ in range(150)]
    before = dict(enumerate(texts))
    sets = {i: shingles(t) for i, t in before.items()}
    want = {i for i in sets if not any(alike(sets[j], sets[i]) for j in range(i))}
    df = spark.createDataFrame(list(before.items()), "doc_id long, text string")
    for spec in (NearSpec(), NearSpec(bucket=3, pivots=2), NearSpec(bucket=2, pivots=1, growth=2), NearSpec(bucket=10**6)):
        assert {r.doc_id for r in without_near_copies(df, spec).collect()} == want


def test_minhash_estimates(spark):
    a = np.random.default_rng(1).integers(0, 2**63, 1000, np.uint64)
    assert abs(len(np.intersect1d(a[:900], a[100:])) / 1000 - 0.8) < 0.01
    one, two = minhash(a[:900], 120), minhash(a[100:], 120)
    assert abs((one == two).mean() - 0.8) < 0.15
    assert minhash(a[:0], 120) is None and len(shingle_hashes("One two", 5)) == 1 and len(shingle_hashes(" \n", 5)) == 0


def test_awkward_rows(spark):
    d = docs(spark).withColumn("b", F.lit(1)).dropDuplicates(["doc_id"])
    left = without_near_copies(d)
    assert left.columns == d.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 3, 4, 5, 6, 7, 8, 9]
    assert without_near_copies(docs(spark, [])).count() == 0
