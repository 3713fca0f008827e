import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F
from tables import docs

from examlens.llm.simhash import BITS, SimHashSpec, fingerprint, fingerprint_hex, grouped_bits, links, near_duplicates, one_of_each, probe_plan, simhash, thresholds


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(BITS) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    d = docs(spark)
    got = {r.doc_id: r.x for r in d.select("doc_id", fingerprint_hex(fingerprint(F.col("text"))).alias("x")).collect()}
    for r in d.collect():
        assert got[r.doc_id] == f"{plain(r.text):016x}"
    assert simhash("One\x85two\x1cthree", 3) & (2**64 - 1) == plain("One\x85two\x1cthree")
    jvm = d.where("doc_id = 8").select(F.hex(F.xxhash64("text")).alias("x")).first().x  # one shingle, so the hash itself
    assert jvm.lower() == got[8]


def roots(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    x = np.array(prints, np.int64).view(np.uint64)
    for i in range(len(x)):
        for j in np.nonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 2)[0] + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def test_links_join_the_same_components_as_all_pairs(spark):
    """Chains, dense groups that pass the bucket limit, and unrelated fingerprints."""
    rng = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(40):
            found.add(at)
            for _ in range(rng.randrange(1, 4)):
                at ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    found |= {centre ^ 1 << a ^ 1 << b for a in range(20) for b in range(20)} | {rng.getrandbits(64) for _ in range(300)}
    prints = sorted(signed(x) for x in found)
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    want = roots(prints)
    for spec in (SimHashSpec(), SimHashSpec(bucket=4), SimHashSpec(bucket=10**6)):
        at = {x: i for i, x in enumerate(prints)}
        parent = list(range(len(prints)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in links(df, spec).collect():
            assert bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2
            a, b = find(at[r.a]), find(at[r.b])
            parent[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(prints))] == want


def test_thresholds_and_parts(spark):
    cost, chosen = thresholds([{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 9, 1: 90}, {-1: 0, 0: 100, 1: 900}], 0)
    assert (cost, chosen) == (50, [1, 0, -1]) or cost <= 59
    both = np.full((BITS, BITS), 25.0) + np.eye(BITS) * 25
    both[3, 60] = both[60, 3] = 50
    parts = grouped_bits(100, both, 3)
    assert sorted(b for p in parts for b in p) == list(range(BITS)) and any({3, 60} <= set(p) for p in parts)
    plan = probe_plan(spark.createDataFrame([(i * 7919,) for i in range(500)], "fp long"))
    assert plan and all(t in (0, 1) for _, t in plan)
    assert probe_plan(spark.createDataFrame([], "fp long"))


def test_awkward_rows(spark):
    d = docs(spark)
    got = near_duplicates(d)
    rows = got.collect()
    assert len(rows) == 11
    of = {r.doc_id: r.component_id for r in rows}
    assert of[2] == 1 and of[4] == 3 and of[6] == 3 and of[8] == 8 and of[None] is None and of[5] == 5
    left = one_of_each(d)
    assert left.columns == d.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 3, 5, 7, 8, 9]
    assert near_duplicates(docs(spark, [])).count() == 0 and one_of_each(docs(spark, [])).count() == 0
