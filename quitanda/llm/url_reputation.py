"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host. Counts are shrunk through beta-binomial
priors: the suffix towards all pages, the registered domain towards its suffix, the host towards its
domain. The strength of each prior is estimated from how much rates differ at that level. A page is
blocked if the lower bound of its host's posterior bad rate is above a limit: few outcomes cannot
block a host. Everything is DataFrame code; what is joined back is one row per host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quitanda.session import materialize


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


# The rule list in use: fixed values.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    """The suffix and the label before it."""
    return F.substring_index(host, ".", -2)


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule); null without one."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        value = F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict string, rule string>")


def _strength(groups: DataFrame, rate: str, floor: float = 2.0, ceiling: float = 1000.0) -> float:
    """Prior strength ``m``: the moment estimate from the groups' spread around the rate expected of each.

    With ``r`` that rate, the squared gap of a group's bad pages from ``n r`` is
    ``n r (1 - r) (1 + (n - 1) / (m + 1))`` on average.
    """
    r, n = F.col(rate), F.col("n")
    base = r * (1 - r)
    over, scale = groups.filter("n > 1").agg(
        F.sum((F.col("bad") - n * r) * (F.col("bad") - n * r) - n * base), F.sum(n * (n - 1) * base)).first()
    return ceiling if (over or 0.0) <= 0 else min(ceiling, max(floor, scale / over - 1))


def reputation(outcomes: DataFrame, z: float = 2.0) -> DataFrame:
    """(host, n, bad, mean, lower) from ``outcomes(host, bad)``: posterior mean and lower bound.

    The prior of a host is the posterior of its domain without that host's own pages, and so upwards:
    no outcome counts twice. A prior is never stronger than the outcomes and the prior behind it. The
    three strengths and the overall counts are single numbers; no outcomes give no rows. Outcomes are
    counted per host once and written; all that follows reads these counts.
    """
    counted = outcomes.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    hosts = (materialize(counted, "host-outcomes").withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()

    def below(groups: DataFrame, above: DataFrame, key: str) -> DataFrame:
        """The groups with the prior that the rest of their parent gives: ``rate`` and its ``weight``."""
        parent = above.select(key, F.col("n").alias("pn"), F.col("bad").alias("pb"), F.col("rate").alias("pr"), F.col("held").alias("pm"))
        total = F.col("pn") - F.col("n") + F.col("pm")
        return groups.join(parent, key).withColumns({
            "rate": (F.col("pb") - F.col("bad") + F.col("pr") * F.col("pm")) / total, "weight": total}).drop("pn", "pb", "pr", "pm")

    def with_prior(groups: DataFrame) -> DataFrame:
        """``held``: the prior's strength, from the spread of the groups and what stands behind it."""
        return groups.withColumn("held", F.least(F.lit(_strength(groups, "rate")), F.col("weight")))

    s = with_prior(suffixes.withColumns({
        "rate": (F.lit(bad) - F.col("bad") + 1) / (F.lit(n) - F.col("n") + 2), "weight": F.lit(n) - F.col("n") + 2}))
    d = with_prior(below(domains, s, "suffix"))
    h = with_prior(below(hosts, d, "domain"))
    a, total = F.col("bad") + F.col("rate") * F.col("held"), F.col("n") + F.col("held")
    return h.select("host", "n", "bad", (a / total).alias("mean"),
                    (a / total - z * F.sqrt(a * (total - a) / (total * total * (total + 1)))).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
          limit: float = 0.5, z: float = 2.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_lower) for every row of ``pages``.

    ``outcomes`` has a page id (``id_col``) and ``bad`` 0/1; null outcomes are none, and a page with
    several counts as the mean over its rows rounded up. A rule decides where one fits; else the page
    is blocked if its host's posterior bad rate is over ``limit`` even at its lower bound. Hosts
    without outcomes have null rates and are allowed. Null urls and those without ``://`` have empty
    host and path, fit no rule and share the empty host's reputation. Repeated pages each give a row;
    null ids have no outcome; other columns are ignored; an empty table gives an empty result.
    """
    placed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                          path_of(F.col(url_col)).alias("path"))
    known = (outcomes.select(F.col(id_col).alias("page_id"), F.col("bad").cast("int").alias("bad")).dropna()
             .groupBy("page_id").agg(F.max("bad").alias("bad")))
    seen = reputation(placed.select("page_id", "host").join(known, "page_id").select("host", "bad"), z)
    hit = match_rule(F.col("host"), F.col("path"), rules)
    return (placed.join(seen.select("host", "mean", "lower"), "host", "left").withColumn("hit", hit)
            .select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                    F.coalesce(F.col("hit.verdict"), F.when(F.col("lower") > limit, "block").otherwise("allow")).alias("verdict"),
                    F.col("mean").alias("bad_rate"), F.col("lower").alias("bad_lower")))
