"""Filter URLs by rules and, where none fits, by the reputation of their host.

The outcomes of labelled pages (blocked or not) are counted per host and shrunk level by level: the rate of all pages is the prior mean
of a suffix, that of the suffix the prior mean of a registered domain, that of the domain the prior mean of a host. Each
prior is a beta distribution whose weight, in pages, is fitted to all groups of its level by moments. A host is blocked
if the upper bound of its posterior rate is above ``most``. Built-in functions only; counts are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.scale import cut_lineage, join_skewed

Rule = tuple[str, str, str]
BLOCK_ABOVE = 0.5
DEVIATIONS = 1.0


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/ ? #`` or the end, A-Z lowered; empty without ``://`` or url."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end; empty without ``://`` or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule ``(verdict, host, path)`` that fits, written host and path together, and its verdict; null if none."""
    rule = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _prior_weight(level: DataFrame, mean: str) -> float:
    """Pages that the prior of a level is worth: the mean square of (rate - prior mean) over groups is m(1-m)/n at least; what
    it has beyond that is the spread between groups."""
    rate, m = F.col("bad") / F.col("n"), F.col(mean)
    row = level.filter("n > 0").agg(
        F.sum(F.col("n") * (rate - m) ** 2), F.sum(m * (1 - m)), F.sum(F.col("n") * m * (1 - m)), F.sum("n"), F.sum(F.lit(1))
    ).first()
    square, within, between, n, groups = (float(x or 0) for x in row)
    spread = (square - within) / between if between else 0.0
    return min(1e6, max(1.0, 1 / spread - 1)) if spread > 1e-6 else 1e6


def host_reputation(outcomes: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """Per host of ``outcomes (host, bad)`` (``bad`` null: not labelled) the posterior mean and its upper bound."""
    label = F.col("bad").cast("int")
    hosts = cut_lineage(outcomes.groupBy("host").agg(F.count(label).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("bad")))
    names = F.split("host", r"\.")
    hosts = hosts.withColumn("suffix", F.element_at(names, -1)).withColumn(
        "domain", F.when(F.size(names) > 1, F.concat_ws(".", F.element_at(names, -2), "suffix")).otherwise(F.col("host")))
    domains = cut_lineage(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).first()[0]

    def shrunk(level: DataFrame, name: str, mean: str) -> DataFrame:
        weight = F.lit(_prior_weight(level, mean))
        return level.withColumn(f"{name}_weight", weight).withColumn(
            f"{name}_rate", (F.col("bad") + weight * F.col(mean)) / (F.col("n") + weight))

    suffixes = shrunk(suffixes.withColumn("whole_rate", F.lit(whole)), "suffix", "whole_rate").select("suffix", "suffix_rate")
    domains = cut_lineage(shrunk(domains.join(suffixes, "suffix"), "domain", "suffix_rate")).select("domain", "domain_rate")
    hosts = shrunk(cut_lineage(hosts.join(domains, "domain")), "host", "domain_rate")
    mean, pages = F.col("host_rate"), F.col("n") + F.col("host_weight")
    upper = F.least(F.lit(1.0), mean + deviations * F.sqrt(mean * (1 - mean) / (pages + 1)))
    return hosts.select("host", F.col("n").alias("labelled"), mean.alias("posterior_rate"), upper.alias("posterior_bound"))


def judge_urls(pages: DataFrame, rules: list[Rule], *, most: float = BLOCK_ABOVE, deviations: float = DEVIATIONS) -> DataFrame:
    """The verdict on every url of ``pages (page_id, url)``; other columns are ignored.

    A page that a rule fits takes its verdict and is a labelled outcome of its host; the others are judged by the
    posterior bound of their host. A url without ``://`` and a null url have an empty host, which is a host like any other. One row
    per row of ``pages``: ``page_id, host, path, rule, verdict, posterior_bound``. An empty table gives an empty one.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, by_rule = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "by_rule": by_rule})
    reputation = host_reputation(ruled.select("host", (F.col("by_rule") == "block").alias("bad")), deviations)
    joined = join_skewed(ruled, cut_lineage(reputation), "host", payload=32)
    verdict = F.coalesce("by_rule", F.when(F.col("posterior_bound") > most, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "posterior_bound")
