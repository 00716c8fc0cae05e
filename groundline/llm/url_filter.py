"""URL filters: explicit rules, and an empirical-Bayes reputation of hosts for the rest.

Labelled pages are counted per host, registered domain (the suffix and one
label) and suffix (the last label, or one of ``SUFFIXES`` under which names are
registered, too). Each level's rate is shrunk to the level above
through a beta prior: with g good of n pages, prior mean m and prior strength
k, the posterior is Beta(k m + g, k (1 - m) + n - g). The strength of a level
is estimated from the spread of its units' rates around the level above
(method of moments), within fixed bounds. A url is blocked if the upper bound
of its host's posterior (mean plus ``z`` standard deviations) is below
``least_good``: few bad pages do not block a host of a good domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Verdict, host, path. Fixed by the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

LEVELS = ("suffix", "domain", "host")

#: Suffixes of two labels under which names are registered. Fixed values.
SUFFIXES = tuple("ac.uk co.uk gov.uk org.uk com.au net.au org.au co.nz co.jp ne.jp or.jp co.kr co.in com.br com.cn com.mx com.tr com.tw co.za".split())


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: what stands after the first ``://``; both empty without it."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)


def suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(SUFFIXES)), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(SUFFIXES)), F.substring_index(host, ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as text) and its verdict; nulls if none does."""
    fits = []
    for verdict, rule_host, rule_path in rules:
        on_host = (host == rule_host) | host.endswith("." + rule_host)
        rule = F.struct(F.lit(len(rule_host + rule_path)).alias("length"), F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(on_host & path.startswith(rule_path), rule))
    best = F.array_max(F.array_compact(F.array(*fits)))
    return best["rule"], best["verdict"]


def _mean_and_upper(a: Column, b: Column, z: float) -> Column:
    mean, deviation = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return F.struct(F.round(mean, 6).alias("mean"), F.round(mean + z * deviation, 6).alias("upper"))


def host_reputation(labelled: DataFrame, *, z: float = 2.0, least: float = 2.0, most: float = 200.0) -> DataFrame:
    """``host, mean, upper`` for every host of ``labelled`` (``host, good``: one row per labelled page)."""
    return reputations(labelled, z=z, least=least, most=most)["host"].select("host", "mean", "upper")


def reputations(labelled: DataFrame, *, z: float = 2.0, least: float = 2.0, most: float = 200.0) -> dict[str, DataFrame]:
    """By level, ``mean`` and ``upper`` of every unit, and ``new``: mean and upper of a host without labels for which this unit is the nearest known.

    Such a host has no count of its own, so its posterior is the prior: the
    unit's mean with the strength of the level below it; for an unknown domain
    or suffix, the strength is that of the first level below the known one.
    Level ``overall`` is one row with ``new`` alone; null where there are no labels.
    Pages without a host (empty) tell nothing about any: they are in no level.
    """
    units = labelled.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("g"))
    units = units.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("host")))
    # One row per host; cut here and at each level, as every level is read several times.
    units = cut(units)
    overall = units.agg(F.sum("n").alias("n"), F.sum("g").alias("g")).select(F.when(F.col("n") > 0, (F.col("g") + 1) / (F.col("n") + 2)).otherwise(F.lit(0.5)).alias("above"))
    above, key = overall.scalar(), None
    result, found, strengths = None, {}, {}
    for level in LEVELS:
        counted = units if level == "host" else units.groupBy(level, *(["suffix"] if level == "domain" else [])).agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
        counted = counted.withColumn("above", above) if key is None else counted.join(result.select(key, F.col("mean").alias("above")), key)
        counted = cut(counted)
        # Method of moments: the spread of rates beyond what binomial noise explains.
        noise = F.sum(F.col("above") * (1 - F.col("above")))
        spread = F.sum(F.col("n") * (F.col("g") / F.col("n") - F.col("above")) * (F.col("g") / F.col("n") - F.col("above")))
        size = F.sum("n")
        strength = counted.agg(F.when(spread > noise, F.round((size * noise / F.count("*") - spread) / (spread - noise), 3)).otherwise(F.lit(most)).alias("k")).select(F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce("k", F.lit(most)))).alias("k")).scalar()
        a, b = F.col("k") * F.col("above") + F.col("g"), F.col("k") * (1 - F.col("above")) + F.col("n") - F.col("g")
        result = counted.withColumn("k", strength).withColumn("a", a).withColumn("b", b).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
        result = cut(result)
        found[level], strengths[level] = result, result.agg(F.max("k")).scalar()
        key = level
    levels = {}
    for level, below in zip(LEVELS, [*LEVELS[1:], None]):
        new = _mean_and_upper(strengths[below] * F.col("mean"), strengths[below] * (1 - F.col("mean")), z) if below else F.lit(None)
        levels[level] = found[level].select(level, new.alias("new"), _mean_and_upper(F.col("a"), F.col("b"), z).alias("own")).select(level, "new", "own.*")
    overall = units.agg(F.sum("n").alias("n")).filter("n > 0").select(above.alias("mean"))
    levels["overall"] = overall.select(_mean_and_upper(strengths["suffix"] * F.col("mean"), strengths["suffix"] * (1 - F.col("mean")), z).alias("new"))
    return levels


def judge_urls(pages: DataFrame, labels: DataFrame, *, rules=RULES, least_good: float = 0.5, z: float = 2.0) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    Labels are matched by page_id = doc_id: a page is good with quality 1 and
    not toxic. Null urls and urls without ``://`` have an empty host and path.
    A host without labelled pages is judged by the prior that its registered
    domain gives, else its suffix, else all labels; where there are no labels,
    every host is allowed. An empty host has no reputation: it is allowed, and the
    labels of its pages count nowhere. Urls of any length are judged
    whole. Repeated rows stay (and repeated labels count again); empty tables
    give empty results; other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    outcome = labels.select(F.col("doc_id").alias("label_id"), ((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("good"))
    levels = reputations(urls.join(outcome, F.col("page_id") == F.col("label_id")).select("host", "good"), z=z)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"))
    for level in ("domain", "suffix"):
        ruled = ruled.join(levels[level].select(level, F.col("new.upper").alias(f"{level}_upper")), level, "left")
    # One row at most: no label at all gives none.
    ruled = ruled.join(F.broadcast(levels["overall"].select(F.col("new.upper").alias("overall_upper"))), F.lit(True), "left")
    ruled = ruled.join(levels["host"].select("host", F.col("upper").alias("host_upper")), "host", "left")
    unlabelled = F.when(F.col("host") != "", F.coalesce("domain_upper", "suffix_upper", "overall_upper"))
    # The join finds nothing for an empty host.
    by_host = F.when(F.coalesce("host_upper", unlabelled) < least_good, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"))
