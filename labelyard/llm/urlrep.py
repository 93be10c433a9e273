"""URL filters by empirical-Bayes host reputation, in DataFrame operations only.

Every page has an outcome (1: bad). Hosts, registered domains and suffixes form a tree. A level's
beta-binomial prior has the mean of the level above and a strength fitted by moments over the
whole level: how much the rates of its members spread beyond what counting alone explains. So
each rate shrinks towards its parent's, the more the fewer pages it has. A page is blocked when
the lower bound of its host's posterior, a quantile of the beta distribution, lies above the
accepted rate: when the distribution function at that rate is at most RISK. Explicit rules come
first.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hot import join_split
from .common import cut

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its own.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Accepted rate of bad pages, and the probability below the posterior's lower bound.
ACCEPTED, RISK = 0.5, 0.05
#: Terms of the beta distribution's continued fraction; enough below LARGE pages. Beyond, the
#: distribution is normal to about three digits.
TERMS, LARGE = 400, 10_000.0
#: Labels below which the registries of countries register names.
SECOND_LEVEL = "ac co com edu gob gov ltd ne net nhs or org plc sch"
#: Limits of a prior's strength in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
#: What isn't visible text of a page.
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[a-z]+;"
LEVELS = ("suffix", "domain", "host")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or has no `://`."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def bad_page(html: Column) -> Column:
    """1 for a page whose visible text is short, mostly symbols, shouted or a table of fragments;
    0 for others; null without a page."""

    def bad(text: Column) -> Column:
        words = F.size(F.split(F.trim(text), r"\s+"))
        length = F.greatest(F.length(text), F.lit(1))
        count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
        symbols, bars, bangs, upper = count("#*$%&"), count("|"), count("!"), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return (words < 30) | (symbols > 0.03 * length) | (bars > 0.2 * words) | (bangs > 0.2 * words) | (upper > 0.3 * length)

    # the text is bound to a name, else every condition would run the regular expression again
    return F.transform(F.array(F.regexp_replace(html, HIDDEN, " ")), bad)[0].cast("int")


def rule_columns(host: str, path: str) -> tuple[Column, Column]:
    """The rule (host and path as one string) and verdict that win for a page, else null: of
    those that fit the longest."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _rates(counts: DataFrame, level: str, above: DataFrame | None) -> DataFrame:
    """``counts`` with prior mean and strength: alpha = k + strength * mean and so on. The mean is
    the posterior mean of the level above from its other members, so that no page counts twice."""
    if above is None:
        total = counts.agg(F.sum("k").alias("tk"), F.sum("n").alias("tn")).first()
        rows = counts.withColumn("mean", (F.lit(total["tk"] or 0) - F.col("k") + 1) / (F.lit(total["tn"] or 0) - F.col("n") + 2))
    else:
        up = LEVELS[LEVELS.index(level) - 1]
        rows = join_split(counts, above.select(up, *[F.col(c).alias(f"up_{c}") for c in ("n", "k", "mean", "strength")]), up, by=level, how="left")
        rows = rows.withColumn("mean", F.expr("(up_k - k + up_strength * up_mean) / (up_n - n + up_strength)"))
    # moments: sum of (k - n m)^2 = sum of n m (1 - m) (1 + (n - 1) rho), strength = 1 / rho - 1
    spread = rows.filter("n > 0").agg(F.sum(F.pow(F.col("k") - F.col("n") * F.col("mean"), 2)).alias("seen"), F.sum(F.expr("n * mean * (1 - mean)")).alias("plain"), F.sum(F.expr("n * (n - 1) * mean * (1 - mean)")).alias("more")).first()
    rho = (spread["seen"] - spread["plain"]) / spread["more"] if spread["more"] else 0.0
    strength = min(STRONGEST, max(WEAKEST, 1 / rho - 1)) if rho > 0 else STRONGEST
    return rows.select(*counts.columns, "mean", F.lit(float(strength)).alias("strength"))


def registered(host: Column) -> tuple[Column, Column]:
    """The registered domain and its suffix: the last two labels of a name, or three where the
    second of them is a registry's under a country's (``co.uk``). A port isn't part of it. Names
    of one label, and addresses of numbers, are their own domain and suffix."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    domain = F.regexp_extract(name, DOMAIN, 1)
    single = (domain == "") | name.rlike("^[0-9.]*$")
    return F.when(single, name).otherwise(domain), F.when(single, name).otherwise(F.regexp_replace(domain, r"^[^.]*\.", ""))


DOMAIN = rf"([^.]+\.(?:{'|'.join(SECOND_LEVEL.split())})\.[a-z][a-z]|[^.]+\.[^.]+)$"


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, for x above 0."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    return series - reduce(lambda s, i: s + F.log(x + i), range(1, 8), F.log(x))


def beta_below(a: Column, b: Column, x: float) -> Column:
    """The beta distribution's function at ``x``, for a, b above 0."""

    def side(p: Column, q: Column, at: float) -> Column:
        def term(i: Column) -> Column:
            m = F.floor(i / 2).cast("double")
            even, odd = m * (q - m) / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) / ((p + 2 * m) * (p + 2 * m + 1))
            return F.when(i % 2 == 0, even).otherwise(odd) * at

        fraction = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda f, i: 1 + term(i) / f)
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * math.log(at) + q * math.log(1 - at))
        return front / p / fraction

    exact = F.when(x < (a + 1) / (a + b + 2), side(a, b, x)).otherwise(1 - side(b, a, 1 - x))
    mean = a / (a + b)
    z = (x - mean) / F.sqrt(mean * (1 - mean) / (a + b + 1))
    normal = 1 / (1 + F.exp(-1.5976 * z - 0.070566 * z * z * z))
    return F.when(a + b <= LARGE, exact).otherwise(normal)


def reputation(pages: DataFrame) -> DataFrame:
    """(host, host_rate, host_risk) from rows (host, outcome); null outcomes don't count.
    host_risk: the probability that the host's rate isn't above the accepted one."""
    domain, suffix = registered(F.col("host"))
    hosts = cut(pages.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("long").alias("k")).select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"))
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    above, found = None, None
    for level, counts in zip(LEVELS, (suffixes, domains, hosts), strict=True):
        above = found = cut(_rates(counts, level, above))
    found = found.withColumn("alpha", F.expr("k + strength * mean")).withColumn("beta", F.expr("n - k + strength * (1 - mean)"))
    return cut(found.select("host", F.expr("alpha / (alpha + beta)").alias("host_rate"), beta_below(F.col("alpha"), F.col("beta"), ACCEPTED).alias("host_risk")))


def judge(pages: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_rate, host_risk) for each row of ``pages``.

    ``outcomes``: labels (page_id, outcome: 1 is bad, null unknown), else ``bad_page`` says. Null
    urls and urls without `://` have an empty host and path and are judged together as one host. A
    page without html has no outcome but is judged by its host. Repeated rows count each.
    """
    host, path = host_and_path(F.col("url"))
    if outcomes is None:
        rows = cut(pages.select("page_id", host.alias("host"), path.alias("path"), bad_page(F.col("html")).alias("outcome")))
    else:
        said = outcomes.groupBy("page_id").agg(F.max("outcome").cast("int").alias("outcome"))
        rows = cut(pages.select("page_id", host.alias("host"), path.alias("path")).join(said, "page_id", "left"))
    rule, verdict = rule_columns("host", "path")
    judged = join_split(rows, reputation(rows), "host", by="page_id", how="left")
    method = F.when(F.col("host_risk") <= RISK, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "host_rate", "host_risk")
