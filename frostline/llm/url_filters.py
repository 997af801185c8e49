"""URL filters by rules, and by trust and distrust that spread over the link graph of hosts.

Trust walks along links from hosts that the rules allow: a personalised PageRank, shared among the hosts that a host
links to. Distrust walks against the links from hosts that the rules block. It isn't shared among a blocked host's
linkers; each takes as much as the share of its own links that goes there, so a host is as bad as the hosts it links
to, however many others link to them too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.sources.shared import written

ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"
HREF = r"""(?i)href\x20*=\x20*["']?\x20*([^"'\x20>]+)"""


@dataclass(frozen=True)
class Rules:
    """(action, rule): a rule is a host with a path prefix, like net/ or example.net/en/. The longest fitting one wins.

    The list is meant to be short (an expression tests each rule).
    """

    rules: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Settings:
    """damping: share of a score that goes on along links. A walk ends when no host has more than tolerance left to
    pass on, or after max_rounds. Hosts with at least min_distrust and more distrust than trust are blocked; a host
    whose pages are all blocked by rules has distrust 1 or more, one that links to nothing else at least the damping."""

    damping: float = 0.7
    tolerance: float = 1e-4
    max_rounds: int = 40
    min_distrust: float = 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Rules) -> Column:
    """(action, rule) of the longest rule that fits, or null. A rule fits its host and all subdomains."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules.rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def links(pages: DataFrame) -> DataFrame:
    """source, target, weight: hosts, and the number of links between them. Links within a host don't count.

    Only links that begin with a scheme or // name a host; an address in the query of another link doesn't. The links
    of a page are counted before the shuffle.
    """
    targets = F.filter(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda x: x.rlike(ABSOLUTE))
    found = pages.where(F.col("html").isNotNull()).select(host_of(F.col("url")).alias("source"), F.explode(targets).alias("link"))
    target = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link")))
    return found.select("source", target.alias("target")).where(
        (F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target"))
    ).groupBy("source", "target").agg(F.count("*").alias("weight"))


def shares(edges: DataFrame) -> DataFrame:
    """source, target, share: the share of the source's links that goes to the target."""
    sums = edges.groupBy("source").agg(F.sum("weight").alias("out"))
    return written(
        edges.join(sums, "source").select("source", "target", (F.col("weight") / F.col("out")).alias("share")), "shares"
    )


def walk(seeds: DataFrame, steps: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """host, score: what the seeds (host, mass) spread over the steps (source, target, share).

    The score of a host is the sum over all walks from the seeds that end there, each step damped. Every round is one
    join and one aggregation, kept as a table; a host with very many links is one that adaptive execution splits.
    """
    front = written(seeds.where(F.col("mass") > 0).select("host", "mass"), "front")
    all_fronts, most, rounds = [front], front.agg(F.max("mass")).first()[0] or 0.0, 0
    while most > settings.tolerance and rounds < settings.max_rounds:
        front = written(
            front.join(steps, F.col("host") == F.col("source")).groupBy("target").agg(
                F.sum(F.col("mass") * F.col("share") * settings.damping).alias("mass")
            ).withColumnRenamed("target", "host"),
            "front",
        )
        most, rounds = front.agg(F.max("mass")).first()[0] or 0.0, rounds + 1
        all_fronts.append(front)
    reached = all_fronts[0]
    for front in all_fronts[1:]:
        reached = reached.unionByName(front)
    return reached.groupBy("host").agg(F.sum("mass").alias("score"))


def judge(pages: DataFrame, rules: Rules, settings: Settings = Settings()) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, trust, distrust.

    pages: page_id, url, html. The rule's action decides where one fits, else the host's scores. Hosts out of reach of
    any seed, and urls without a host, are allowed. A host's seed is the share of its pages that rules allow or block.
    Null or empty pages have no links; repeated rows count each; an empty table gives no rows; other columns don't
    matter.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    ruled = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "found", rule_for(F.col("host"), F.col("path"), rules))
    action = F.col("found")["action"]
    hosts = written(
        ruled.where(F.col("host") != "").groupBy("host").agg(
            F.avg((F.coalesce(action, F.lit("")) == "allow").cast("double")).alias("allowed"),
            F.avg((F.coalesce(action, F.lit("")) == "block").cast("double")).alias("blocked"),
        ),
        "hosts",
    )
    ahead = shares(written(links(pages), "links"))
    back = ahead.select(F.col("target").alias("source"), F.col("source").alias("target"), "share")
    trust = walk(hosts.select("host", F.col("allowed").alias("mass")), ahead, settings).withColumnRenamed("score", "trust")
    distrust = walk(hosts.select("host", F.col("blocked").alias("mass")), back, settings).withColumnRenamed("score", "distrust")
    scores = written(trust.join(distrust, "host", "full_outer").na.fill(0.0, ["trust", "distrust"]), "scores")
    judged = ruled.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") >= settings.min_distrust) & (F.col("distrust") > F.col("trust"))
    return judged.select(
        "page_id", "host", "path", F.col("found")["rule"].alias("rule"),
        F.coalesce(action, F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "trust", "distrust",
    )
