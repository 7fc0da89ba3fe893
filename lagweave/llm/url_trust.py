"""URL filter: rules first, then trust and distrust that spread over the graph of hosts.

Hosts most of whose ruled pages are allowed are trusted seeds, the others blocked seeds. Trust is a
personalised PageRank from the trusted seeds along links between hosts; distrust is one from the
blocked seeds against the links, so that it reaches the hosts that link to blocked ones. A page that
no rule fits is blocked where its host's distrust exceeds its trust by the threshold or more.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm.shared import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that are part of the plan; more are looked up.
RULES_IN_PLAN = 200
KNOWN = "struct<rule: string, verdict: string>"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @classmethod
    def read(cls, line: str) -> Rule:
        """From a line such as `block example.org/es/`."""
        verdict, text = line.split()
        host, slash, path = text.partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"no rule: {line}")
        return cls(verdict, host.lower(), slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting(spark: SparkSession, host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits (of equal ones the first by text, block before allow): a struct, without rule if none fits.

    Few rules are one expression. More are sent to the executors, as they come from the driver in
    any case, and each page's host and the domains above it are looked up.
    """
    ordered = sorted(set(rules), key=rank)
    if not ordered:
        return F.lit(None).cast(KNOWN)
    if len(ordered) > RULES_IN_PLAN:
        table = spark.sparkContext.broadcast(RuleTable(ordered))

        def known(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
            return table.value.known(hosts, paths)

        return F.pandas_udf(known, KNOWN)(host, path)
    out = None
    for r in ordered:
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def rank(rule: Rule) -> tuple[int, str, bool]:
    return -len(rule.text), rule.text, rule.verdict != "block"


class RuleTable:
    """Rules by host and path, and the lengths of each host's paths."""

    def __init__(self, ordered: list[Rule]):
        self.rules: dict[str, dict[str, Rule]] = {}
        for r in ordered:
            self.rules.setdefault(r.host, {}).setdefault(r.path, r)
        self.lengths = {host: sorted({len(p) for p in paths}, reverse=True) for host, paths in self.rules.items()}

    def longest(self, host: str, path: str) -> Rule | None:
        fits, domain = [], host
        while domain:
            for n in self.lengths.get(domain, ()):
                if n <= len(path) and (rule := self.rules[domain].get(path[:n])):
                    fits.append(rule)
                    break
            domain = domain.partition(".")[2]
        return min(fits, key=rank, default=None)

    def known(self, hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [self.longest(h, p) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame({"rule": [r and r.text for r in found], "verdict": [r and r.verdict for r in found]}, dtype=object)


def host_links(pages: DataFrame) -> DataFrame:
    """(a, b, n): links in html from host a to another host b. Relative links stay on their host."""
    target = F.regexp_extract(F.col("link"), "//([^/?#]*)", 1)
    links = pages.where("host <> ''").select(F.col("host").alias("a"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    links = links.select("a", F.translate(target, UPPER, LOWER).alias("b")).where("b <> '' and a <> b")
    return links.groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int) -> DataFrame:
    """(host, score): personalised PageRank over edges (a, b, n) from seeds (host, weight); weights sum to 1."""
    share = edges.join(edges.groupBy("a").agg(F.sum("n").alias("all")), "a").select("a", "b", (F.col("n") / F.col("all")).alias("share"))
    share = saved(share, "shares")
    base = seeds.select("host", (F.col("weight") * (1 - damping)).alias("score"))
    score = base
    for i in range(rounds):
        moved = share.join(score, F.col("a") == F.col("host")).select(F.col("b").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        score = moved.union(base).groupBy("host").agg(F.sum("score").alias("score"))
        if i % 4 == 3:
            score = saved(score, "scores")
    return score


def judged(pages: DataFrame, rules: list[Rule], damping: float = 0.85, rounds: int = 20, threshold: float = 1e-12) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each row of pages (page_id, url, html).

    Without a rule, a host whose distrust exceeds its trust by less than the threshold, or that has
    neither, is allowed; so are pages without a host. A null html has no links. Repeated rows are
    judged each. Other columns are dropped.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "html", host.alias("host"), path.alias("path"))
    known = fitting(pages.sparkSession, F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("known", known)
    votes = ruled.where("host <> '' and known.rule is not null").groupBy("host").agg(
        F.sum(F.when(F.col("known.verdict") == "allow", 1).otherwise(-1)).alias("vote"))
    votes = saved(votes, "votes")
    edges = saved(host_links(rows), "links")
    linked = not edges.isEmpty()

    def scores(good: bool) -> DataFrame:
        seeds = votes.where("vote > 0" if good else "vote <= 0")
        n = seeds.count()
        seeds = seeds.select("host", F.lit(1.0 / max(n, 1)).alias("weight"))
        if not linked or not n:
            return seeds.select("host", (F.col("weight") * (1 - damping)).alias("score"))
        return spread(edges if good else edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"), seeds, damping, rounds)

    trust, distrust = scores(True).withColumnRenamed("score", "trust"), scores(False).withColumnRenamed("score", "distrust")
    hosts = saved(trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"]), "hosts")
    out = ruled.drop("html").join(hosts, "host", "left").na.fill(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("known.rule").alias("rule"), F.coalesce("known.verdict", own).alias("verdict"), "trust", "distrust")
