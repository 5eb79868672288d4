"""URL filter: rules by host and path, and a verdict per host from the link graph for pages that no rule fits.

Trust and distrust are personalised PageRanks over the edges between hosts, ``x = seeds + damping * flow(x)``:
trust starts at hosts with allowed pages and flows along links, distrust starts at hosts with blocked pages and
flows against them, from a host to those that link to it. A host's seed is the share of its pages that a rule
allows (blocks). An edge's weight is the number of pages of one host that link to the other; links within a host
say nothing about it and are left out, and what reaches a host without edges stops there. A host is blocked where
its distrust is above its trust and at least ``threshold`` of that of a wholly blocked host.

Ranks are whole numbers (``UNIT`` is one whole seed, at most 2^33 seed hosts fit a long), so neither the order of
sums nor a repeated task changes a verdict. After ``rounds`` rounds a seed further away adds less than
``damping ** rounds``. A page names a host once, edges are counted before they are shuffled, and one row a host
and direction goes through the rounds, so that a host with a third of all pages is one row there. Joins on a
hot host have one row a host on their other side; adaptive skew splitting cuts the hot side.

All is DataFrame functions. Null, empty and relative urls have an empty host and path, no node, and the verdict
allow. Null html has no links. Repeated rows give repeated results; an empty table an empty one. Of the page table only the
three named columns are read, so clashing names in others do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.jobs import cut

UNIT = 1 << 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The target of an anchor; it ends at the next ``<`` at the latest, so unclosed tags cost no rescans.
ANCHOR = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?([^"'\s<>]*)"""
#: The host of a link that names one.
ELSEWHERE = r"^(?:[Hh][Tt][Tt][Pp][Ss]?:)?//([^/?#\\]*)"


@dataclass(frozen=True)
class Propagation:
    damping: float = 0.85
    rounds: int = 20
    rounds_a_cut: int = 5
    threshold: float = 0.5


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) of a list of rules."""
    each = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))
    return spark.range(1, numPartitions=1).select(F.inline(each))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``verdict`` of the longest rule that fits (of equal ones the longer host) to (host, path).

    A host's own rules and those of the domains above it are gathered beside the host, so the work per page is
    one look-up; what is gathered grows with the rules of one domain, not with the pages.
    """
    deepest = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"] or 1
    labels = pages.select("host").distinct().withColumn("labels", F.split("host", r"\."))
    count = F.size("labels")
    above = F.transform(F.sequence(F.greatest(F.lit(1), count - deepest + 1), count), lambda i: F.array_join(F.slice("labels", i, count), "."))
    length = F.length("rules.host") + F.length("rules.path")
    each = F.struct((-length).alias("length"), (-F.length("rules.host")).alias("depth"), F.col("rules.path").alias("path"),
                    F.concat("rules.host", "rules.path").alias("rule"), F.col("rules.verdict").alias("verdict"))
    near = labels.select("host", F.explode(above).alias("domain")).join(rules.alias("rules"), F.col("domain") == F.col("rules.host"))
    near = near.groupBy(labels["host"]).agg(F.array_sort(F.collect_list(each)).alias("near"))
    fitting = F.try_element_at(F.filter("near", lambda r: F.startswith("path", r["path"])), F.lit(1))
    return pages.join(near, "host", "left").withColumn("fits", fitting).select(
        *pages.columns, F.col("fits.rule").alias("rule"), F.col("fits.verdict").alias("verdict")
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, pages): how many pages of one host link to another; of (host, html)."""
    target = lambda link: F.translate(F.regexp_extract(link, ELSEWHERE, 1), UPPER, LOWER)
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)), target))
    found = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(links).alias("dst"))
    return found.where("dst != '' and dst != src").groupBy("src", "dst").agg(F.count("*").alias("pages"))


def host_seeds(judged: DataFrame) -> DataFrame:
    """(way, host, mass): way 1 is trust, way -1 distrust; of (host, verdict)."""
    share = lambda verdict: F.floor(F.count(F.when(F.col("verdict") == verdict, 1)) * F.lit(float(UNIT)) / F.count("*"))
    hosts = judged.where("host != ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    ways = F.array(F.struct(F.lit(1).alias("way"), F.col("allowed").alias("mass")), F.struct(F.lit(-1).alias("way"), F.col("blocked").alias("mass")))
    return hosts.select("host", F.inline(ways)).where("mass > 0").select("way", "host", "mass")


def propagate(seeds: DataFrame, edges: DataFrame, how: Propagation = Propagation()) -> DataFrame:
    """(way, host, mass) of every host that trust or distrust reaches."""
    both = edges.select(F.lit(1).alias("way"), "src", "dst", "pages").unionAll(
        edges.select(F.lit(-1).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "pages")
    )
    totals = both.groupBy("way", "src").agg(F.sum("pages").alias("total"))
    shares = cut(both.join(totals, ["way", "src"]).select("way", "src", "dst", (F.col("pages") / F.col("total")).alias("share")))
    seeds = cut(seeds)
    if shares.isEmpty():
        return seeds
    ranks = seeds
    for k in range(how.rounds):
        held = ranks.select(F.col("way").alias("of"), "host", "mass")
        flow = held.join(shares, (F.col("of") == F.col("way")) & (F.col("host") == F.col("src")))
        moved = flow.select("way", F.col("dst").alias("host"), F.floor(F.col("mass") * F.lit(how.damping) * F.col("share")).alias("mass"))
        ranks = moved.where("mass > 0").unionAll(seeds).groupBy("way", "host").agg(F.sum("mass").alias("mass"))
        if k % how.rounds_a_cut == how.rounds_a_cut - 1:
            ranks = cut(ranks)
    return ranks


def blocked_hosts(ranks: DataFrame, how: Propagation = Propagation()) -> DataFrame:
    """The hosts that the ranks block."""
    of = lambda way: F.coalesce(F.sum(F.when(F.col("way") == way, F.col("mass"))), F.lit(0))
    found = ranks.groupBy("host").agg(of(1).alias("trust"), of(-1).alias("distrust"))
    return found.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= F.lit(how.threshold * UNIT))).select("host")


def judge(pages: DataFrame, rules: DataFrame, how: Propagation = Propagation(), page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, host, path, rule, verdict) of every page: a rule's verdict, or else its host's by the link graph."""
    host, path = host_and_path(F.col(url))
    judged = ruled(pages.select(F.col(page).alias("page"), host.alias("host"), path.alias("path")), rules)
    edges = host_edges(pages.select(host.alias("host"), F.col(html).alias("html")))
    blocked = blocked_hosts(propagate(host_seeds(judged), edges, how), how).select(F.col("host").alias("bad"))
    found = judged.join(blocked, F.col("host") == F.col("bad"), "left")
    graph = F.when(F.col("bad").isNotNull(), "block").otherwise("allow")
    return found.select(F.col("page").alias(page), "host", "path", "rule", F.coalesce("verdict", graph).alias("verdict"))
