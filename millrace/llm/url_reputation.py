"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Labelled outcomes of pages (good or bad) are counted by host, registered domain
and suffix. Counts are shrunk down that ladder by beta-binomial priors: a
suffix's prior mean is the rate of all labelled pages, a domain's is its
suffix's posterior mean, a host's is its domain's. How many labelled pages a
prior weighs at a level is fitted to the table by the method of moments (the
spread of the rates of the level's units beyond binomial noise), and is never
more than the labelled pages that the prior itself rests on. A page is
blocked if even the upper bound of its host's posterior stays below
``least_good``; few or no labels leave the host with its parents' rate, so an
unknown host passes unless its whole domain or suffix is known to be bad.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lower_ascii, table

#: (host/path, verdict)
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Public suffixes of two labels under which names are registered.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "or.jp", "org.au", "org.uk")
LEAST_GOOD, Z, PRIOR_MOST, PRIOR_LEAST = 0.5, 1.6448536269514722, 1000.0, 2.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, else nulls."""
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        best, verdict = F.when(fits, rule).otherwise(best), F.when(fits, says).otherwise(verdict)
    return best, verdict


def _tail(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def host_ladder(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Suffix and registered domain of a host; a short host is both itself.

    A user name before ``@``, a port and dots at the end are left out. An
    address (four numbers, or in brackets) is its own suffix and domain.
    """
    name = F.rtrim(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", ""), F.lit("."))
    address = name.rlike(r"^(\[|[0-9]{1,3}(\.[0-9]{1,3}){3}$)")
    wide = _tail(name, 2).isin(*suffixes)
    suffix = F.when(address, name).when(wide, _tail(name, 2)).otherwise(_tail(name, 1))
    return suffix, F.when(address, name).when(wide, _tail(name, 3)).otherwise(_tail(name, 2))


def prior_weight(units: DataFrame) -> float:
    """The labelled pages that a prior of this level is worth.

    Method of moments for a beta-binomial over ``units(n, good, mean)``, mean
    being the prior mean of each unit: with s = sum (good - n*mean)^2, its value
    is sum n*v*(1 + (n-1)*rho), v = mean*(1-mean); rho is solved for and
    weight = 1/rho - 1, held between PRIOR_LEAST and PRIOR_MOST.
    """
    v = F.col("mean") * (1 - F.col("mean"))
    sums = units.agg(
        F.sum(F.pow(F.col("good") - F.col("n") * F.col("mean"), 2)).alias("s"),
        F.sum(F.col("n") * v).alias("a"),
        F.sum(F.col("n") * (F.col("n") - 1) * v).alias("b"),
    ).first()
    rho = (sums.s - sums.a) / sums.b if sums.b else 0.0
    weight = 1 / min(rho, 1.0) - 1 if rho > 1 / (1 + PRIOR_MOST) else PRIOR_MOST
    return max(PRIOR_LEAST, weight)


def _posterior(units: DataFrame, *keys: str) -> DataFrame:
    """``units(n, good, mean, known)`` shrunk to the prior; ``known`` becomes what the posterior rests on."""
    # A prior weighs no more than what its own level knows.
    weight = F.greatest(F.lit(PRIOR_LEAST), F.least(F.lit(prior_weight(units)), "known"))
    return units.select(*keys, ((F.col("good") + weight * F.col("mean")) / (F.col("n") + weight)).alias("mean"), (F.col("n") + weight).alias("known"))


def _below(units: DataFrame, parents: DataFrame, *keys: str) -> DataFrame:
    """``units`` with what their parents pass down; a null key is a key of its own."""
    fits = [F.col(f"u.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    return units.alias("u").join(parents.alias("p"), fits).select("u.*", "p.mean", "p.known")


def reputation(hosts: DataFrame) -> DataFrame:
    """Posterior of each of ``hosts(host, suffix, domain, n, good)``, a written table.

    Adds post_n, post_mean, upper. ``n`` may be 0. Without any labelled page the
    rate of all is taken as 1 (nothing is known to be bad). A null domain or
    suffix is a unit of its own. The three prior weights are numbers of one
    aggregate each; the levels are joined by key.
    """
    counts = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    total = hosts.agg(*counts).first()
    rate, known = (total.good / total.n if total.n else 1.0), float(total.n or 0)
    domains = hosts.groupBy("suffix", "domain").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts).withColumns({"mean": F.lit(rate), "known": F.lit(known)})
    down = _posterior(suffixes, "suffix")
    down = _posterior(_below(domains, down, "suffix"), "suffix", "domain")
    own = _posterior(_below(hosts, down, "suffix", "domain"), "host", "n", "good")
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("known") + 1))
    return own.select("host", "n", "good", F.col("known").alias("post_n"), F.col("mean").alias("post_mean"), F.least(F.lit(1.0), F.col("mean") + Z * spread).alias("upper"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, least_good: float = LEAST_GOOD, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Verdict on every page url.

    ``outcomes(page_id, good)`` holds labelled pages: good 1 or 0; rows with a
    null are ignored, and repeated rows count once each. ``suffixes`` are the
    public suffixes of two labels under which names are registered. Returns page_id, host,
    path, rule, verdict, labelled (pages of the host), post_mean and upper. A
    null url, or one without ``://``, has an empty host and path; empty hosts
    share one reputation. Null page_ids have no label. Extra columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.select(F.col("page_id"), F.col("good").cast("long").alias("good")).dropna()
    labelled = parts.select("page_id", "host").join(known, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = parts.groupBy("host").agg(F.count("*").alias("pages")).join(labelled, "host", "left").fillna(0, ["n", "good"])
    suffix, domain = host_ladder(F.col("host"), suffixes)
    hosts = Workspace(pages.sparkSession, "hosts").put(hosts.select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "good"), "hosts")
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("upper") < least_good, "block").otherwise("allow")
    return parts.join(reputation(hosts), "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, judged).alias("verdict"), F.col("n").alias("labelled"), "post_mean", "upper")


def labelled_pages(labels: DataFrame) -> DataFrame:
    """Labels by page: a page is good if its quality is 1 and it isn't toxic."""
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.select(F.col("doc_id").alias("page_id"), good.cast("long").alias("good"))


def op1_url_reputation(spark, sf_dir):
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labelled_pages(table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict", "labelled")


def _level(units: str, into: str) -> str:
    """SQL for the prior weight of a level."""
    return f"""{into} AS (SELECT greatest(2.0, coalesce(CASE WHEN rho > 1 / 1001.0 THEN 1 / least(rho, 1.0) - 1 ELSE 1000.0 END, 1000.0)) AS weight FROM (
  SELECT CASE WHEN b > 0 THEN (s - a) / b ELSE 0.0 END AS rho FROM (
    SELECT sum(power(good - n * mean, 2)) AS s, sum(n * mean * (1 - mean)) AS a, sum(n * (n - 1) * mean * (1 - mean)) AS b FROM {units})))"""


_TWO = ", ".join(f"'{s}'" for s in SUFFIXES)
ORACLE = rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT doc_id AS page_id, CASE WHEN coalesce(quality, 0) = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END AS good FROM labels WHERE doc_id IS NOT NULL),
c AS (SELECT host, count(*) AS n, sum(good) AS good FROM p JOIN k USING (page_id) GROUP BY host),
b AS (SELECT DISTINCT host, rtrim(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '.') AS name FROM p),
s AS (SELECT host, name, regexp_matches(name, '^(\[|[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$)') AS address, string_split(name, '.') AS parts,
             coalesce(n, 0)::DOUBLE AS n, coalesce(good, 0)::DOUBLE AS good FROM b LEFT JOIN c USING (host)),
h AS (SELECT host, n, good, CASE WHEN address THEN name ELSE array_to_string(parts[-w:], '.') END AS suffix, CASE WHEN address THEN name ELSE array_to_string(parts[-(w + 1):], '.') END AS domain
      FROM (SELECT *, CASE WHEN array_to_string(parts[-2:], '.') IN ({_TWO}) THEN 2 ELSE 1 END AS w FROM s)),
rate AS (SELECT CASE WHEN sum(n) > 0 THEN sum(good) / sum(n) ELSE 1.0 END AS mean, coalesce(sum(n), 0) AS known FROM h),
d AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM h GROUP BY 1, 2),
l1 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(mean) AS mean, any_value(known) AS known FROM d, rate GROUP BY 1),
{_level("l1", "w1")},
m1 AS (SELECT suffix, (good + w * mean) / (n + w) AS mean, n + w AS known FROM (SELECT *, greatest(2.0, least(weight, known)) AS w FROM l1, w1)),
l2 AS (SELECT suffix, d.domain, d.n, d.good, m1.mean, m1.known FROM d JOIN m1 USING (suffix)),
{_level("l2", "w2")},
m2 AS (SELECT suffix, domain, (good + w * mean) / (n + w) AS mean, n + w AS known FROM (SELECT *, greatest(2.0, least(weight, known)) AS w FROM l2, w2)),
l3 AS (SELECT h.host, h.n, h.good, m2.mean, m2.known FROM h JOIN m2 USING (suffix, domain)),
{_level("l3", "w3")},
m3 AS (SELECT host, n, (good + w * mean) / (n + w) AS mean, n + w AS post_n FROM (SELECT *, greatest(2.0, least(weight, known)) AS w FROM l3, w3)),
v AS (SELECT host, n::BIGINT AS labelled, CASE WHEN mean + 1.6448536269514722 * sqrt(mean * (1 - mean) / (post_n + 1)) < 0.5 THEN 'block' ELSE 'allow' END AS judged FROM m3),
r AS (SELECT page_id, host, path, labelled, judged, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM p JOIN v USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE judged END AS verdict, labelled FROM r
"""
