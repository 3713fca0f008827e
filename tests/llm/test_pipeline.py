"""The stages against plain versions on the small tables, and that nothing is lost on the way."""

from collections import defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from examlens.llm import quality
from examlens.llm.common import read
from examlens.llm.simhash import simhash
from test_decontaminate import plain as leaked
from test_nearcopies import holds
from test_simhash import roots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = read(spark, SF, "documents"), []
    for name, f in pipeline.STAGES:
        docs = f(spark, docs, SF)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema) if name != "sharding" else docs
        out.append((name, docs.columns, rows))
    return out


def test_stages(spark, steps):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "simhash", "decontamination", "mixing", "sharding"]
    start = read(spark, SF, "documents")
    before = start.collect()
    for name, columns, rows in steps[:-1]:
        assert columns == start.columns
    good, single, clean, mixed, sharded = (rows for _, _, rows in steps)

    model = quality.learn(start, read(spark, SF, "labels"))
    hashes = quality.WordHashes()
    assert sorted(r.doc_id for r in good) == [r.doc_id for r in sorted(before) if model.score(r.text, hashes) >= 0.3]

    prints = [simhash(r.text, 3) for r in good]
    distinct = sorted(set(prints))
    root = dict(zip(distinct, roots(distinct)))
    lowest = defaultdict(lambda: 10**18)
    for r, fp in zip(good, prints):
        lowest[root[fp]] = min(lowest[root[fp]], r.doc_id)
    left = set(lowest.values())
    holds({r.doc_id: r.text for r in good if r.doc_id in left}, {r.doc_id for r in single})
    assert len({r.doc_id for r in single}) == len(single)

    items = [r.text.lower().split() for r in read(spark, SF, "benchmark").collect()]
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single if not any(leaked(r.text.lower().split(), i) for i in items))

    n, times = {r.doc_id: len(r.text.split()) for r in clean}, defaultdict(int)
    for r in mixed:
        times[r.doc_id] += 1
    assert max(times.values()) <= 3 and set(times) <= set(n)
    assert abs(sum(n[i] * k for i, k in times.items()) - sum(n.values())) < 0.2 * sum(n.values())
    assert sorted(r.doc_id for r in sharded) == sorted(r.doc_id for r in mixed)
    per = defaultdict(list)
    for r in sharded:
        per[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in per.values())


def test_run_is_the_stages(spark, steps):
    got = entry.queries()["pipeline"](spark, SF)
    assert sorted((r.doc_id, r.shard) for r in got.collect()) == sorted((r.doc_id, r.shard) for r in steps[-1][2])
    assert got.columns == steps[-1][1]
