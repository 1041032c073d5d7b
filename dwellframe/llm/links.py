"""URL filters: rules first, then trust and distrust spread over the host graph.

Explicit rules decide the urls they fit. For all other urls the host decides:
personalised PageRank spreads trust from hosts with allowed pages along links,
and distrust from hosts with blocked pages against them (who links to a bad
host is suspect). What a link brings to a host is cut by the share of its pages
that rules block, so trust does not pass through blocked hosts. A host is
blocked when its distrust passes a threshold and its trust.

Defined results: a null url, or one without ``://``, has an empty host and path
and is allowed; null pages have no links; repeated rows are judged alike and
count for each row; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellframe.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The host of a link that names one; a relative link stays on its own host.
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits the host or a parent of it and starts the path; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, weight): links from host to host, counted before they are shuffled; own links left out."""
    links = pages.select(url_host(F.col(url)).alias("src"), F.explode(
        F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("weight"))


def page_rank(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 12,
              rounds_per_table: int = 4, closed: DataFrame | None = None) -> DataFrame:
    """(host, score): personalised PageRank from (host, seed) along (src, dst, weight).

    ``closed`` (host, share) takes that share off whatever links bring to a host.

    Scores are scaled by the seeds' sum, so a seed without any links scores its
    own seed value and the scale does not shrink as hosts are added. A host
    without links out keeps what reaches it. Each round is one join on the
    link's source and one pre-aggregated sum by its target; the lineage is cut
    by a written table every few rounds, and older ones are dropped.
    """
    scratch = Scratch(seeds.sparkSession)
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("host"), F.lit(1).alias("out")),
        F.struct(F.col("dst").alias("host"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    nodes = seeds.select("host", "seed", F.lit(0).alias("out")).unionByName(
        ends.select("host", F.lit(0.0).alias("seed"), "out")).groupBy("host").agg(
        F.sum("seed").alias("seed"), F.max("out").alias("out"))
    nodes = scratch.keep(nodes, "hosts")
    out_sum = edges.groupBy(F.col("src").alias("o_src")).agg(F.sum("weight").alias("out_weight"))
    parts = edges.join(out_sum, F.col("src") == F.col("o_src")).select(
        "src", "dst", (F.col("weight") / F.col("out_weight")).alias("part"))
    if closed is not None:
        parts = parts.join(closed.select(F.col("host").alias("dst"), "share"), "dst", "left").select(
            "src", "dst", (F.col("part") * (1 - F.coalesce("share", F.lit(0.0)))).alias("part"))
    steps = parts.unionByName(
        nodes.where("out = 0").select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("part")))
    steps = scratch.keep(steps, "steps")
    now, old = nodes.select("host", F.col("seed").alias("score")), []
    for i in range(rounds):
        came = now.join(steps, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(
            F.sum(F.col("score") * F.col("part")).alias("came"))
        now = nodes.join(came, F.col("host") == F.col("to"), "left").select(
            "host", (F.lit(1 - damping) * F.col("seed")
                     + F.lit(damping) * F.coalesce("came", F.lit(0.0))).alias("score"))
        if (i + 1) % rounds_per_table == 0 or i + 1 == rounds:
            now = scratch.keep(now, "ranks")
            scratch.drop(*old)
            old = [now]
    return now


def judge_pages(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html",
                carry: Sequence[str] = (), block_at: float = 0.5, damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """Carried columns, host, path, rule, verdict, trust and distrust of every row.

    A host's seeds are the shares of its pages that rules allow and block. A
    host whose distrust reaches ``block_at`` and passes its trust is blocked
    where no rule fits. Links and urls are read once each and counted by host
    before anything is shuffled, so a host with a third of all pages costs one row
    per task.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = url_host(F.col(url)), url_path(F.col(url))
    seen = pages.select(*carry, host.alias("host"), path.alias("path"))
    seen = seen.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    seen = scratch.keep(seen, "urls")
    share = [F.avg((F.col("fit.verdict").eqNullSafe(v)).cast("double")).alias(n)
             for v, n in (("allow", "allowed"), ("block", "blocked"))]
    hosts = scratch.keep(seen.where("host <> ''").groupBy("host").agg(*share), "host-seeds")
    edges = scratch.keep(host_edges(pages, url, html), "host-edges")
    trust = page_rank(hosts.select("host", F.col("allowed").alias("seed")), edges, damping, rounds,
                      closed=hosts.where("blocked > 0").select("host", F.col("blocked").alias("share")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = page_rank(hosts.select("host", F.col("blocked").alias("seed")), back, damping, rounds)
    scores = scratch.keep(trust.select("host", F.col("score").alias("trust")).join(
        distrust.select("host", F.col("score").alias("distrust")), "host", "full"), "host-scores")
    out = seen.join(scores, "host", "left")
    bad = F.coalesce((F.col("distrust") >= block_at) & (F.col("distrust") > F.col("trust")), F.lit(False))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow"))
    return out.select(*carry, "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"),
                      F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
