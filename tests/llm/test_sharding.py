import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tables import docs, tuples

from examlens.llm.sharding import Tree, assign_shards, shard_of


def test_awkward_rows(spark):
    got = assign_shards(docs(spark), Tree.of(40), Tree.of(41)).collect()
    assert len(got) == 11
    by = {(r.doc_id, r.size, r.text_crc32): r for r in got}
    assert by[(4, 16, None)].law == "key" and by[(3, 16, 0)].size == 16
    text = "äöü ß É — ñ 漢字"
    assert by[(7, 16 + len(text.encode()), zlib.crc32(text.encode()))]
    ties = [r for r in got if r.doc_id == 8]
    assert len({r.shard for r in ties}) == 1 and len({r.slot for r in ties}) == 2
    for shard, n in Counter(r.shard for r in got).items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    assert assign_shards(docs(spark, []), Tree.of(40)).count() == 0


def test_one_more_shard_only_takes(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    counts = [40, 41, 42, 43]
    rows = ids.select(*[shard_of(F.col("doc_id"), Tree.of(n)).alias(f"s{n}") for n in counts]).collect()
    for a, b in zip(counts, counts[1:]):
        moved = [r for r in rows if r[f"s{a}"] != r[f"s{b}"]]
        assert all(r[f"s{b}"] == a for r in moved)
        assert abs(len(moved) - 20_000 / b) < 5 * (20_000 / b) ** 0.5
    share = Counter(r.s40 for r in rows)
    assert len(share) == 40 and max(share.values()) < 1.3 * 500


def test_weight_change_stays_in_its_subtree(spark):
    """A heavier shard draws keys into its region, rack and shard; outside of these nobody gains."""
    def tree(w):
        return Tree(tuple(tuple(tuple((r * 4 + k * 2 + i, w if (r, k, i) == (0, 0, 0) else 1.0) for i in range(2)) for k in range(2)) for r in range(2)))

    rows = spark.range(20_000).select(shard_of(F.col("id"), tree(1.0)).alias("a"), shard_of(F.col("id"), tree(3.0)).alias("b")).where("a <> b").collect()
    for r in rows:
        assert r.b // 4 == 0  # every move ends in the region whose weight grew
        if r.a // 4 == 0:
            assert r.b // 2 == 0  # from inside it, in the rack whose weight grew
        if r.a // 2 == 0:
            assert r.b == 0
    share = spark.range(20_000).select(shard_of(F.col("id"), tree(3.0)).alias("s")).where("s = 0").count() / 20_000
    assert abs(share - 0.3) < 0.02


def test_bad_trees():
    for build in (lambda: Tree.of(39), lambda: Tree((((),),)), lambda: Tree(((((0, 0.0),),),)), lambda: Tree(((((0, 1.0), (0, 1.0)),),))):
        with pytest.raises(ValueError):
            build()
