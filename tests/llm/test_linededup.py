from collections import defaultdict

from tables import docs

from examlens.llm.linededup import SpreadSpec, drop_boilerplate


def test_awkward_rows(spark):
    got = {(r.doc_id, r.text): r for r in drop_boilerplate(docs(spark), spec=SpreadSpec(min_sites=2)).collect()}
    assert (1, "") in got and (2, "") in got  # the same line on sites a and b
    assert got[(1, "")].n_removed == 1 and got[(4, None)].n_lines == 0
    assert got[(9, "line one\nline two\n\nline one")].n_lines == 4
    assert drop_boilerplate(docs(spark, [])).count() == 0
    assert len(drop_boilerplate(docs(spark)).collect()) == 11


def test_near_and_far_from_the_threshold(spark):
    rows, sites = [], defaultdict(set)
    for k, n in enumerate([1, 3, 4, 5, 6, 40, 200]):
        for i in range(n):
            rows.append((len(rows), f"own {len(rows)}\n  line {k} \nlast {i}", "en", f"s{i}", 0))
            for line in (f"line {k}", f"last {i}", f"own {len(rows) - 1}"):
                sites[line].add(f"s{i}")
    for spec in (SpreadSpec(min_sites=5), SpreadSpec(min_sites=5, log_k=4)):
        for r in drop_boilerplate(docs(spark, rows), spec=spec).collect():
            want = "\n".join(x for x in rows[r.doc_id][1].split("\n") if len(sites[x.strip()]) < 5)
            assert r.text == want and r.n_lines == 3


def test_white_space_at_the_ends_is_no_difference(spark):
    """The same line with and without a carriage return, tab or form feed, half of the sites each."""
    ends = ["", "\r", "\t", "\f\v", " \r"]
    rows = [(i, f"own {i}\r\n{ends[i % 5]}All rights{ends[i % 5]}\nend {i}", "en", f"s{i}", 0) for i in range(8)]
    for r in drop_boilerplate(docs(spark, rows)).collect():
        assert r.text == f"own {r.doc_id}\r\nend {r.doc_id}" and r.n_removed == 1
