"""URL filter: rules by host and path, and link-graph propagation where no rule speaks.

Hosts with pages that a rule allows are trusted seeds, hosts with pages that a rule blocks
are distrusted ones. Personalised PageRank carries trust from the trusted seeds along the
links between hosts, and distrust from the blocked seeds against them: who links to blocked
hosts gets distrust. A host whose distrust passes its trust is blocked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stage

LINK = r"""(?i)<a\s[^>]*href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    picked = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        picked = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(picked)
    return picked


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) over the absolute links from pages of one host to another host."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
    ends = links.select("src", lower_ascii(F.regexp_extract("link", "//([^/?#]*)", 1)).alias("dst"))
    return ends.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-9) -> DataFrame:
    """(kind, host, rank) from seeds (kind, host, seed) over edges (kind, src, dst, links).

    Each round a host keeps (1 - damping) of its seed and gets damping times what its
    neighbours pass on in proportion to their links. Mass at a host without links out is lost,
    so ranks of a kind sum to 1 at most. Rounds end when no further host is reached and the sum of all
    ranks moves by no more than the tolerance; what can still move shrinks by `damping` each round.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("links").alias("out"))
    shares = stage(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("links") / F.col("out")).alias("share")), "shares")
    base = stage(seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("base")), "seeds")
    rank = base.select("kind", "host", F.col("base").alias("rank"))
    if shares.isEmpty():
        return rank
    mass, reached = -1.0, -1
    while True:
        moved = shares.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank"))
        rank = stage(moved.union(base.select("kind", "host", "base")).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "rank")
        now, hosts = rank.agg(F.sum("rank"), F.count("*")).first()  # ranks only grow towards their limit, so the sum tells
        if now is None or (now - mass <= tolerance and hosts == reached):
            return rank
        mass, reached = now, hosts


def host_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, margin: float = 0.0) -> DataFrame:
    """(host, trust, distrust, verdict) for each host that trust or distrust reaches."""
    host = host_of(F.col("url"))
    seeded = pages.select(host.alias("host"), rule_for(host, path_of(F.col("url")), rules)["verdict"].alias("kind")).where("kind is not null")
    counts = stage(seeded.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = counts.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed"))  # totals: a row for each verdict
    edges = stage(host_edges(pages), "links")
    both = edges.select(F.lit("allow").alias("kind"), "src", "dst", "links").union(edges.select(F.lit("block"), F.col("dst"), F.col("src"), "links"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    ranked = propagate(seeds, both).groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))
    return ranked.withColumn("verdict", F.when(F.col("distrust") - F.col("trust") > margin, "block").otherwise("allow"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    - a null url or one without "://" has an empty host and path, no rule fits it, and it is allowed;
    - a null html has no links; a host that no trust and no distrust reaches is allowed;
    - repeated rows are judged alike, each with a row of its own; an empty table gives none;
    - other columns of `pages` are ignored.
    """
    pages = pages.select("page_id", "url", "html")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    blocked = host_verdicts(pages, rules).where("verdict = 'block'").select("host", F.lit("block").alias("by_graph"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), rule_for(host, path, rules).alias("r"))
    return judged.join(blocked, "host", "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "by_graph", F.lit("allow")).alias("verdict"))
