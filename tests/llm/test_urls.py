from examlens.llm.urls import RULES, host_verdicts, judge_urls, propagate

COLUMNS = "page_id long, url string, html string, host string, rule string, seed string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h in rows], COLUMNS)


def to(*hosts):
    return " ".join(f'<A class="x" HREF = "https://{h}/p?q">x</a>' for h in hosts)


def test_awkward_rows_and_rules(spark):
    rows = [
        (1, None, None), (2, "no scheme/at/all", ""), (3, "http://Example.NET/en/x?a=/b#c", None), (4, "ftp://www.example.net/fr/", "<a href='/x'>"),
        (5, "://net/", None), (6, "http://notnet/", None), (7, "http://a.net", None), (8, "http://x.org/fr/1://2", None), (9, "http://EXAMPLE.com/de/", None),
        (10, "http://x.com/de/", None), (10, "http://x.com/de/", None), (None, "http://example.comx/de/#://net/", "y" * 100_000), (12, "http://ÀÉ.org?/fr/", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages(spark, rows)).collect()}
    assert got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("example.net", "/en/x", "example.net/en/", "allow")
    assert got[4] == ("www.example.net", "/fr/", "net/", "block")
    assert got[5] == ("net", "/", "net/", "block") and got[6] == ("notnet", "/", None, "allow") and got[7] == ("a.net", "", None, "allow")  # its path does not start with the rule's
    assert got[8] == ("x.org", "/fr/1://2", "org/fr/", "allow") and got[9][2:] == ("example.com/de/", "block")
    assert got[10] == ("x.com", "/de/", None, "allow") and got[None] == ("example.comx", "/de/", None, "allow") and got[12] == ("ÀÉ.org", "", None, "allow")
    assert judge_urls(pages(spark, rows)).count() == len(rows)
    assert judge_urls(pages(spark, [])).count() == 0


def test_distrust_runs_against_links_and_trust_along_them(spark):
    rows = [
        (1, "http://bad.net/x", to("victim.com")), (2, "http://good.org/fr/", to("friend.com", "both.com")),
        (3, "http://farm.com/", to("bad.net")), (4, "http://ring.com/", to("farm.com")), (5, "http://friend.com/", to("bad.net", "good.org", "good.org", "good.org")),
        (6, "http://victim.com/", ""), (7, "http://alone.com/", to("alone.com")), (8, "http://both.com/", ""),
    ]
    got = {r.page_id: r.verdict for r in judge_urls(pages(spark, rows)).collect()}
    links = {("bad.net", "victim.com"): 1, ("good.org", "friend.com"): 1, ("good.org", "both.com"): 1, ("farm.com", "bad.net"): 1, ("ring.com", "farm.com"): 1, ("friend.com", "bad.net"): 1, ("friend.com", "good.org"): 3}

    def rank(seed, edges):
        r = {}
        for _ in range(300):
            out = {h: sum(n for (a, _), n in edges.items() if a == h) for h, _ in edges}
            r = {h: 0.15 * (h == seed) + 0.85 * sum(r.get(a, 0) * n / out[a] for (a, b), n in edges.items() if b == h) for e in edges for h in e}
        return r

    trust, distrust = rank("good.org", links), rank("bad.net", {(b, a): n for (a, b), n in links.items()})
    by_graph = {h: "block" if distrust[h] > trust[h] else "allow" for h in trust}
    assert by_graph["farm.com"] == by_graph["ring.com"] == "block" and by_graph["victim.com"] == by_graph["both.com"] == "allow"
    hosts = {3: "farm.com", 4: "ring.com", 5: "friend.com", 6: "victim.com", 8: "both.com"}
    assert got == {1: "block", 2: "allow", 7: "allow", **{i: by_graph[h] for i, h in hosts.items()}}


def test_ranks_against_plain_iteration(spark):
    edges = [("a", "b", 1), ("b", "c", 2), ("b", "a", 1), ("c", "a", 1), ("d", "c", 3)]
    seeds = {"a": 0.75, "d": 0.25}
    rank = {h: 0.15 * seeds.get(h, 0) for h in "abcd"}
    out = {h: sum(n for s, _, n in edges if s == h) for h in "abcd"}
    for _ in range(200):
        rank = {h: 0.15 * seeds.get(h, 0) + 0.85 * sum(rank[s] * n / out[s] for s, d, n in edges if d == h) for h in "abcd"}
    got = propagate(
        spark.createDataFrame([("allow", h, s) for h, s in seeds.items()], "kind string, host string, seed double"),
        spark.createDataFrame([("allow", *e) for e in edges], "kind string, src string, dst string, links long"))
    assert all(abs(r["rank"] - rank[r.host]) < 1e-6 for r in got.collect())
    assert len(RULES) == 4


def test_a_chain_of_many_hosts(spark):
    """Distrust goes back along any number of links; a host behind the blocked one gets none."""
    name = lambda i: "far.net" if i == 45 else f"h{i}.com"
    rows = [(i, f"http://{name(i)}/", f'<a href="http://{name(i + 1)}/x">x</a>') for i in range(45)] + [(45, "http://far.net/", '<a href="http://after.com/">x</a>'), (46, "http://after.com/", None)]
    got = {r.page_id: r.verdict for r in judge_urls(pages(spark, rows)).collect()}
    assert got == {**{i: "block" for i in range(46)}, 46: "allow"}
