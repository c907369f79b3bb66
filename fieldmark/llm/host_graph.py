"""URL filter: rules first, then trust and distrust spread over host links. DataFrame functions only."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.base import broadcast_if, settle

DAMPING = 0.85
# Ranks are final when none changes by more than this share of itself; verdicts compare at ten times that.
TOLERANCE = 1e-7
# The longest run: beyond 4,600 links a rank (0.85 ** 4600) is less than the smallest double.
ROUNDS = 4600


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed by the contract.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty without :// and for NULL."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, NULL if none does. Ties of length: the first listed."""
    ordered = sorted(rules, key=lambda r: -len(r.name))
    pick = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pick = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(pick)
    return pick


def host_links(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """(src, dst, links): numbers of absolute links between different hosts."""
    pattern = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
    found = F.when(F.contains(html, F.lit("//")), F.regexp_extract_all(html, F.lit(pattern), 1))
    return (pages.select(host.alias("src"), F.explode(found).alias("dst")).withColumn("dst", lower_ascii(F.col("dst")))
            .where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("links")))


def personal_rank(links: DataFrame, seeds: DataFrame, name: str, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank: (host, <name>) from links (src, dst, links) and seeds (host, weight).

    A host passes its rank on in proportion to its links; the walk restarts at the seeds.
    What a host without links would pass on leaves the walk. Rounds end when no host is
    newly reached and no rank changes by more than TOLERANCE of itself.
    """
    total = seeds.agg(F.sum("weight")).first()[0]
    start = settle(seeds.select("host", (F.col("weight") / F.lit(float(total or 1))).alias("start")), "seeds")
    out = links.groupBy("src").agg(F.sum("links").alias("all"))
    shares = settle(links.join(out, "src").select("src", "dst", (F.col("links") / F.col("all")).alias("share")), "shares")
    rank = start.withColumnRenamed("start", "rank")
    for _ in range(rounds if total else 0):
        passed = shares.join(rank, shares["src"] == rank["host"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("passed"))
        new = start.join(passed.withColumnRenamed("dst", "host"), "host", "full").select(
            "host", ((1 - damping) * F.coalesce("start", F.lit(0.0)) + damping * F.coalesce("passed", F.lit(0.0))).alias("rank"))
        old = rank.select("host", F.col("rank").alias("old"))
        both = settle(new.join(old, "host", "left").withColumn("moves", F.abs(F.col("rank") - F.coalesce("old", F.lit(0.0))) > TOLERANCE * F.col("rank")), "rank")
        rank = both.select("host", "rank")
        if both.where("moves").isEmpty():
            break
    return rank.withColumnRenamed("rank", name)


def verdict_of(trust: str, distrust: str) -> Column:
    """Compared by share, so that it does not depend on the number of seeds."""
    return F.when(F.col(distrust) > F.col(trust) * (1 + 10 * TOLERANCE), "block").otherwise("allow")


def judge_hosts(judged: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust, verdict) for hosts that either reaches.

    Every host with pages that rules decide is a seed: of trust with the pages it has
    allowed beyond its blocked ones, of distrust with those blocked beyond its allowed
    ones; as many of both say nothing. Trust follows links from trusted seeds; distrust runs
    against them from blocked seeds, to hosts that link there. A host is blocked if its
    distrust is above its trust by more than a millionth; hosts reached by neither are
    allowed (they are not in the result).
    """
    hosts = settle(judged.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("match.verdict") == "allow").alias("good"),
        F.count_if(F.col("match.verdict") == "block").alias("bad")), "hosts")
    links = settle(links, "links")
    if links.isEmpty():
        links = links.limit(0)
        rounds = 0
    good = hosts.where("good > bad").select("host", (F.col("good") - F.col("bad")).alias("weight"))
    bad = hosts.where("bad > good").select("host", (F.col("bad") - F.col("good")).alias("weight"))
    trust = personal_rank(links, good, "trust", damping, rounds)
    against = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = personal_rank(against, bad, "distrust", damping, rounds)
    both = trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"])
    return both.withColumn("verdict", verdict_of("trust", "distrust"))


def judge_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES,
                damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    The longest fitting rule decides; without one the verdict of the page's host does.
    NULL urls and urls without :// have an empty host and path and are allowed; NULL
    html has no links; repeated rows are pages of their own and count as such; no pages
    give no rows; other columns are ignored.
    """
    own = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = settle(own.withColumn("match", matching_rule(F.col("host"), F.col("path"), rules)), "judged")
    links = host_links(pages, host_of(F.col(url)), F.col(html).cast("string"))
    hosts = settle(judge_hosts(judged, links, damping, rounds), "verdicts")
    return (judged.join(broadcast_if(hosts.withColumnRenamed("verdict", "host_verdict")), "host", "left")
            .select("page_id", "host", "path", F.col("match.rule").alias("rule"),
                    F.coalesce("match.verdict", "host_verdict", F.lit("allow")).alias("verdict"),
                    F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
