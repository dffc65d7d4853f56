"""URL filter: rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes (good or bad) are counted by host. A beta-binomial prior passes down from
all pages to the suffix, the registered domain and the host: each level's groups are shrunk
towards their parent's mean with a strength that the spread of that level's own groups gives
(method of moments). A host passes if its posterior's lower bound of the good share is high enough.
DataFrame operations only; hosts, not pages, are what the levels are computed from, and each level
is a written table. Pages of hot hosts meet them by broadcast, the others by a shuffle.

Defined results: a null url or one without `://` has an empty host and path, fits no rule and is
judged as the host ''; a null page_id is judged but has no outcome; a page with several outcomes
counts each; without any outcome every host has the mean `start`; repeated rows are judged
alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

#: Labels under which countries register names by category. Before a country's label of two letters
#: they make a suffix of two labels; elsewhere the suffix is the last label. A whole table of suffixes can be given.
CATEGORIES = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "gv", "mil", "ne", "net", "nom", "or", "org", "plc", "res", "sch")
TWO_LABELS = rf"^({'|'.join(CATEGORIES)})\.[a-z]{{2}}$"
#: Bounds of a level's intra-class correlation; strength of its prior is 1 / correlation - 1.
LEAST_CORRELATION, MOST_CORRELATION = 0.001, 0.5
#: A host with over one in so many pages is hot: there are fewer of such than this, so they are broadcast.
HOT = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

Rule = tuple[str, str]


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def two_labels(pair: Column, suffixes: Sequence[str]) -> Column:
    known = pair.rlike(TWO_LABELS)
    return known | pair.isin(*suffixes) if suffixes else known


def host_suffix(host: Column, suffixes: Sequence[str] = ()) -> Column:
    pair = F.substring_index(host, ".", -2)
    return F.when(two_labels(pair, suffixes), pair).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column, suffixes: Sequence[str] = ()) -> Column:
    pair = F.substring_index(host, ".", -2)
    return F.when(two_labels(pair, suffixes), F.substring_index(host, ".", -3)).otherwise(pair)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, action) of the longest rule that fits, compiled into one expression; null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(chosen)
    return chosen


def shrunk(groups: DataFrame, parent: str, name: str) -> DataFrame:
    """`groups` (n, good, parent mean) with the level's strength and each group's posterior mean, as a written table."""
    n, k, p = F.col("n"), F.col("good"), F.col(parent)
    spread = F.sum((k - n * p) * (k - n * p)) - F.sum(n * p * (1 - p))
    room = F.sum(n * (n - 1) * p * (1 - p))
    correlation = F.greatest(F.lit(LEAST_CORRELATION), F.least(F.lit(MOST_CORRELATION), F.coalesce(F.try_divide(spread, room), F.lit(LEAST_CORRELATION))))
    groups = written(groups, f"{name}-counts")
    strength = groups.agg((1 / correlation - 1).alias("strength"))  # one row
    out = written(groups.crossJoin(F.broadcast(strength)).withColumn("mean", (k + F.col("strength") * p) / (n + F.col("strength"))), name)
    discard(groups)
    return out


def host_reputation(hosts: DataFrame, z: float, start: float, suffixes: Sequence[str] = ()) -> DataFrame:
    """(host, pages, mean, bound) from the written (host, pages, n, good), a row for each host; a written table."""
    named = hosts.withColumns({"suffix": host_suffix(F.col("host"), suffixes), "domain": registered_domain(F.col("host"), suffixes)})
    total = hosts.agg(F.coalesce(F.try_divide(F.sum("good"), F.sum("n")), F.lit(start)).alias("all_mean"))  # one row
    suffixes = shrunk(named.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).crossJoin(F.broadcast(total)), "all_mean", "suffixes")
    domains = named.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains = shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("suffix_mean")), "suffix"), "suffix_mean", "domains")
    each = shrunk(named.join(domains.select("domain", F.col("mean").alias("domain_mean")), "domain"), "domain_mean", "hosts")
    weight = F.col("n") + F.col("strength")
    out = each.select("host", "pages", "mean", (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (weight + 1))).alias("bound"))
    discard(suffixes, domains)
    return out


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], least_good: float = 0.7, z: float = 1.645, start: float = 0.5, suffixes: Sequence[str] = ()) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) of each row of `pages` (page_id, url).

    outcomes: (page_id, good), good 0 or 1; suffixes: of two labels, besides those of TWO_LABELS. A host is allowed if with the one-sided confidence
    of `z` standard deviations at least `least_good` of its pages are good.
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = urls.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    marks = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("good").cast("long").alias("good")).where("good is not null")
    counts = urls.join(marks, "page_id", "left").groupBy("host").agg(F.count("*").alias("pages"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    counts = written(counts, "counts")
    known = host_reputation(counts, z, start, suffixes)
    pages_in_all = counts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    is_hot = F.col("pages") * HOT > pages_in_all
    hot, other = known.where(is_hot).select("host", "bound"), known.where(~is_hot).select("host", "bound")
    judged = urls.join(F.broadcast(hot), "host").unionByName(urls.join(F.broadcast(hot), "host", "left_anti").join(other, "host"))
    discard(counts)
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bound") >= least_good, F.lit("allow")).otherwise(F.lit("block"))
    judged = judged.withColumn("fit", fit)
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", by_host).alias("verdict"), "bound")


def rule_sql(rules: Sequence[Rule]) -> str:
    """The SQL of `fitting_rule`: a CASE that gives the longest fitting rule, as (rule, action)."""
    cases = []
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, rest = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}') THEN {{'rule': '{rule}', 'action': '{action}'}}")
    return reduce(lambda a, b: f"{a} {b}", cases, "CASE") + " END"
