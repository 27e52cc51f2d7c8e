"""Judge urls by rules, and hosts without a rule by their reputation.

A page with a labelled outcome is good or bad. The bad rate of a host is
shrunk by beta-binomial priors: a suffix towards the rate of all pages, a
registered domain towards its suffix, a host towards its domain. How strongly
a level pulls is learnt from the data (empirical Bayes): the more the units of
a level differ beyond what chance explains, the weaker is its prior. A host is
blocked where a lower bound of its posterior rate passes the limit; hosts
without labelled pages have their domain's rate as it is.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.shared import saved

# Common suffixes of two labels. All others have one.
TWO_LABELS = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
    "com.mx", "com.tr", "com.tw", "edu.au", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
)

# Block where the bad rate is above LIMIT by BOUND posterior standard deviations.
LIMIT, BOUND = 0.5, 1.645
# Bounds of the correlation between outcomes of one unit, and its value where the data tell nothing.
LEAST_RHO, MOST_RHO, UNKNOWN_RHO = 0.001, 0.5, 0.1


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        """From `net/` or `example.com/de/`."""
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    """What stands after the first `://`, with A-Z in lower case; empty without it."""
    found = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest of `rules` that fits, as a struct (`rule`, `verdict`); null without one.

    Of equally long rules the one with the longer host wins, then `block`.
    The list is part of the plan, so it should stay below some hundreds.
    """
    order = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.verdict != "block"))

    def fits(r: Rule) -> Column:
        return ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)

    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    made = [F.when(fits(r), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in order]
    return F.coalesce(*made, none)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix; an address of numbers and a suffix alone are both of them.

    A user and a port do not count.
    """
    bare = F.regexp_replace(host, r"^.*@|:\d*$", "")
    two = F.substring_index(bare, ".", -2)
    of_two = two.isin(*TWO_LABELS)
    suffix = F.when(of_two, two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(of_two, F.substring_index(bare, ".", -3)).otherwise(two)
    numbers = F.regexp_like(bare, F.lit(r"(^|\.)\d+$"))
    return F.when(numbers, bare).otherwise(domain), F.when(numbers, bare).otherwise(suffix)


def _strength(units: DataFrame) -> Column:
    """The prior's weight in pages, from units (`n`, `k`, `base`): pages, bad ones, the rate one level up.

    If outcomes of one unit have the correlation rho, (k - n base)^2 is
    n base (1 - base) (1 + (n - 1) rho) on average. Sums are decimal, so
    that they do not depend on the order of the rows.
    """
    exact = lambda x: F.coalesce(F.sum(x.cast("decimal(38,12)")), F.lit(0)).cast("double")
    n, k, base = (F.col(c).cast("double") for c in ("n", "k", "base"))
    noise = base * (1 - base)
    sums = units.agg(
        exact((k - n * base) * (k - n * base) - n * noise).alias("more"), exact(n * (n - 1) * noise).alias("pairs")
    )
    rho = F.when(F.col("pairs") > 0, F.least(F.lit(MOST_RHO), F.greatest(F.lit(LEAST_RHO), F.col("more") / F.col("pairs"))))
    return sums.select((1 / F.coalesce(rho, F.lit(UNKNOWN_RHO)) - 1).alias("strength")).scalar()


def _shrunk(units: DataFrame) -> DataFrame:
    """`units` with the `weight` of their prior and their posterior `rate`."""
    weighed = units.withColumn("weight", _strength(units))
    return weighed.withColumn("rate", (F.col("k") + F.col("weight") * F.col("base")) / (F.col("n") + F.col("weight")))


def reputation(
    pages: DataFrame, outcomes: DataFrame, id_column: str = "page_id", url_column: str = "url", bound: float = BOUND
) -> DataFrame:
    """Rows (`host`, `domain`, `suffix`, `n`, `k`, `rate`, `lower`), one for each host of `pages`.

    `outcomes` (id, `bad` boolean) may repeat an id; one bad outcome is
    enough, null tells nothing. `n` labelled pages of the host have an outcome
    and `k` a bad one; `rate` is its posterior mean and `lower` the mean less
    `bound` standard deviations. A null url and one without `://` have an
    empty host. Repeated pages count each. No pages give no rows.
    """
    told = outcomes.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max("bad").alias("bad"))
    urls = pages.select(F.col(id_column).alias("id"), host_of(F.col(url_column)).alias("host"))
    domain, suffix = domain_and_suffix(F.col("host"))
    bad = F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k")
    counted = urls.join(told, "id", "left").groupBy("host").agg(F.count("bad").alias("n"), bad)
    # One row per host, which all levels start from.
    hosts = saved(counted.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"))
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = hosts.groupBy("suffix").agg(*sums)
    # The rate of all pages under Jeffreys' prior.
    overall = hosts.agg(*sums).select(((F.coalesce("k", F.lit(0)) + 0.5) / (F.coalesce("n", F.lit(0)) + 1)).alias("base")).scalar()
    by_suffix = _shrunk(suffixes.withColumn("base", overall)).select("suffix", F.col("rate").alias("base"))
    by_domain = _shrunk(domains.join(by_suffix, "suffix")).select("domain", "suffix", F.col("rate").alias("base"))
    rated = _shrunk(hosts.join(by_domain, ["domain", "suffix"]))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("weight") + 1))
    return rated.select("host", "domain", "suffix", "n", "k", "rate", (F.col("rate") - bound * spread).alias("lower"))


def judged(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    id_column: str = "page_id",
    url_column: str = "url",
    limit: float = LIMIT,
    bound: float = BOUND,
) -> DataFrame:
    """Rows (`id`, `host`, `path`, `rule`, `verdict`), one for each row of `pages`.

    The longest rule that fits the host or a domain above it, and whose path
    begins the url's, decides; its text stands in `rule`. Other pages, `rule`
    null, are blocked where the lower bound of their host's `reputation`
    passes `limit`. Nulls, repeats and empty tables are as there.
    """
    host, path = host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path")
    rows = pages.select(F.col(id_column).alias("id"), host, path)
    ruled = rows.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    known = reputation(pages, outcomes, id_column, url_column, bound)
    blocked = known.select("host", (F.col("lower") > limit).alias("blocked"))
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    both = ruled.join(blocked, "host")
    return both.select("id", "host", "path", "by.rule", F.coalesce("by.verdict", own).alias("verdict"))
