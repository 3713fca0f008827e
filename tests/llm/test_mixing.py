from collections import defaultdict

from tables import docs, tuples

from examlens.llm.mixing import MixSpec, mix, mixed_documents, source_targets, taken_words


def test_awkward_rows(spark):
    pieces = mix(docs(spark))
    got = taken_words(pieces).collect()
    assert len(got) == 11
    sizes = sorted((r.doc_id or -1, r.size) for r in got)
    assert (3, 0) in sizes and (4, 0) in sizes and (5, 30_000) in sizes and (6, 0) in sizes
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by = defaultdict(int)
    for r in got:
        by[r.target] += r.taken
    assert all(abs(taken - target) <= 0.5 * sum(1 for _ in by) for target, taken in by.items() if target)
    assert tuples(taken_words(mix(docs(spark))), "*") == tuples(taken_words(mix(docs(spark))), "*")
    assert taken_words(mix(docs(spark, []))).count() == 0


def test_targets(spark):
    rows = spark.createDataFrame([("b", 1000), ("a", 10), ("c", 100), (None, 40), ("é", 0)], "source string, words long")
    got = {r.source: r for r in source_targets(rows).collect()}
    assert [got[s].weight for s in ("a", "b", "c", "é", None)] == [1, 2, 3, 1, 2]
    assert got["a"].target == 30 and got["é"].target == 0 and got["c"].target == 300 and got[None].target == 120
    assert abs(sum(r.target for r in got.values()) - 1150) < 1e-9


def test_schedule_interleaves_and_gives_the_quota(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "en", "abc"[i % 3 if i % 5 else 0], 0) for i in range(900)]
    pieces = mix(docs(spark, rows, clash=False), MixSpec(blocks=200))
    got = pieces.where("slot is not null").collect()
    quota = {r.source: round(r.target) for r in got}
    words = defaultdict(int)
    for r in got:
        words[r.source] += r.words
    assert words == quota
    # Up to any point of the mix, each source has about its share.
    total, seen, done = sum(quota.values()), defaultdict(int), 0
    for r in sorted(got, key=lambda r: r.slot):
        seen[r.source] += r.words
        done += r.words
        if done > total / 4:
            assert abs(seen[r.source] / done - quota[r.source] / total) < 0.05
    per = defaultdict(int)
    for r in got:
        per[(r.doc_id, r["pass"])] += r.words
    assert all(w <= 5 + i % 7 for (i, _), w in per.items())


def test_documents_repeat_as_the_mix_does(spark):
    rows = [(i, "w " * 10, "en", "ab"[i >= 10], 20) for i in range(40)]
    out = mixed_documents(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n == {"a": 13, "b": 27}  # weights 1 and 2 over 400 words, source a has 100
    awkward = mixed_documents(docs(spark))
    assert {3, 4, 6} <= {r.doc_id for r in awkward.collect()}  # no words, no share: they stay
    assert mixed_documents(docs(spark, [])).count() == 0
