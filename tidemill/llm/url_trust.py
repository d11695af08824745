"""URL filters: rules on hosts and paths, and link-graph propagation for the other pages.

Hosts that rules allow or block are seeds. Trust is a personalised PageRank from trusted
seeds along host edges, distrust one from blocked seeds against them, so that it reaches
hosts that link to blocked ones. A page without a rule gets its host's verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm._common import settle

#: Change of all ranks together in a round, each kind of which sums to 1, at which they stand.
TOLERANCE = 1e-4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_of(url: str | Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    found = F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def path_of(url: str | Column) -> Column:
    """After the host up to ? # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matches(rule: Rule, host: str = "host", path: str = "path") -> Column:
    own = (F.col(host) == rule.host) | F.col(host).endswith("." + rule.host)
    return own & F.col(path).startswith(rule.path)


def rule_of(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits a row's host and path, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        text = F.when(matches(rule), rule.text).otherwise(text)
        verdict = F.when(matches(rule), rule.verdict).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame, *, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, n): links from pages of a host to a host, its own among them, counted before they are shuffled further.

    Links are the values of href and src. Those that name no host are relative and lead to the
    page's own host; schemes without a host (``mailto:``) lead nowhere. Null and empty html has
    no links; a page that comes twice counts twice.
    """
    named = F.regexp_extract_all(F.col(html), F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    links = pages.select(F.col(host).alias("src"), F.explode(named).alias("link"))
    to = F.when(F.col("link").startswith("//"), host_of(F.concat(F.lit("x:"), F.col("link")))).when(F.col("link").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), host_of("link")).otherwise(F.col("src"))
    return links.select("src", to.alias("dst")).where("dst <> '' AND src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, *, rounds: int | None = None, tolerance: float = TOLERANCE, damping: float = 0.85) -> DataFrame:
    """(host, trust, distrust) of every host that a seed reaches.

    seeds: (host, trust, distrust), weights that are not negative; each column is scaled to
    sum 1. Both ranks move in one pass: trust along edges, distrust against them, each edge
    with its share of what leaves the node. What has nowhere to go returns to the seeds. A
    node's ranks are a row; edges are joined to them, so a hub is on the edges' side only.

    Without ``rounds`` the ranks move until no new host is reached and all of them together
    change by ``tolerance`` at most; what is left to move is then under ``damping`` /
    (1 - ``damping``) of that.
    """
    sums = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d"))
    total = sums.first()
    scaled = settle(
        seeds.select(F.lit("trust").alias("kind"), F.col("host").alias("node"), (F.col("trust") / (float(total["t"] or 0) or 1.0)).alias("start"))
        .union(seeds.select(F.lit("distrust"), "host", F.col("distrust") / (float(total["d"] or 0) or 1.0)))
        .where("start > 0")
    )
    ways = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("node"), F.col("dst").alias("to"), "n").union(edges.select(F.lit("distrust"), "dst", "src", "n"))
    leaving = ways.groupBy("kind", "node").agg(F.sum("n").alias("all"))
    ways = settle(ways.join(leaving, ["kind", "node"]).select("kind", "node", "to", (F.col("n") / F.col("all")).alias("share")))
    now = scaled.select("kind", "node", F.col("start").alias("rank"))
    turn, reached = 0, -1
    while turn != rounds and ways.take(1):
        moved = ways.join(now, ["kind", "node"]).groupBy("kind", F.col("to").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("moved"))
        held = moved.groupBy("kind").agg(F.sum("moved").alias("arrived"))
        # Ranks of a kind sum to 1: what did not arrive starts at the seeds again.
        none = F.lit(0.0)
        back = scaled.join(held, "kind", "left").select("kind", "node", (F.col("start") * (1 - damping * F.coalesce("arrived", none))).alias("rank"), none.alias("was"))
        parts = moved.select("kind", "node", (F.col("moved") * damping).alias("rank"), none.alias("was")).union(back).union(now.select("kind", "node", none, "rank"))
        now = settle(parts.groupBy("kind", "node").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")))
        after = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("rank") - F.col("was"))).alias("change")).first()
        now, turn = now.drop("was"), turn + 1
        if rounds is None and after["n"] == reached and after["change"] <= tolerance:
            break
        reached = after["n"]
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return now.groupBy(F.col("node").alias("host")).agg(of("trust"), of("distrust"))


def host_seeds(pages: DataFrame) -> DataFrame:
    """(host, trust, distrust): the shares of a host's pages that rules allow and block."""
    shares = pages.where("host <> ''").groupBy("host").agg(F.avg((F.coalesce("ruled", F.lit("")) == "allow").cast("double")).alias("trust"), F.avg((F.coalesce("ruled", F.lit("")) == "block").cast("double")).alias("distrust"))
    return shares.where("trust > 0 OR distrust > 0")


def judge(pages: DataFrame, *, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.5, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict, trust, distrust.

    The longest rule that fits decides. Without one, a page is blocked if distrust is more
    than ``threshold`` of its host's trust and distrust, else allowed, as are pages without
    a host and hosts that no seed reaches. Pages that repeat come again, and their links and
    rules count again; a null url has an empty host, a null html no links.
    """
    rule, verdict = rule_of(rules)
    parsed = pages.select(F.col(key).alias("key"), F.col(html).alias("html"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parsed.withColumns({"rule": rule, "ruled": verdict})
    edges = settle(host_edges(parsed))
    # A row for each host and no page: joined to the pages, a hot host is on their side only.
    ranks = settle(propagate(edges, host_seeds(ruled), tolerance=tolerance))
    ruled = ruled.drop("html").join(ranks, "host", "left")
    shady = F.coalesce(F.try_divide("distrust", F.col("trust") + F.col("distrust")), F.lit(0.0)) > threshold
    return ruled.select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("ruled", F.when(shady, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
