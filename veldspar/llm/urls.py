"""URL filter: host rules first, else an empirical-Bayes reputation of the host.

Labelled outcomes of pages (bad or not) are counted per host and shrunk down a tree of
beta-binomial priors: global -> public suffix -> registered domain -> host.  Each level's
prior strength comes from its own counts by moments (how much more the children's rates
vary than binomial noise would make them); the prior mean is the parent's posterior mean.
A host is blocked when the lower posterior bound of its bad rate exceeds a limit.

All of it is DataFrame expressions.  Counts are aggregated before any join, so a hot host
is one row; only counts per host, domain and suffix are joined, never page contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.session import written

#: (host, path, verdict), as the contract of the query states them.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BAD_RATE = 0.5
Z = 1.645
MAX_INLINE_RULES = 256


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path); a null url or one without ``://`` has both empty."""
    url = pages.select("page_id", F.coalesce("url", F.lit("")).alias("__url"))
    after = F.when(F.col("__url").contains("://"), F.expr("substring(__url, length(substring_index(__url, '://', 1)) + 4)")).otherwise(F.lit(""))
    cut = url.select("page_id", after.alias("__after")).select("page_id", "__after", F.regexp_extract("__after", r"(?s)^([^/?#]*)", 1).alias("__host"))
    rest = F.expr("substring(__after, length(__host) + 1)")
    path = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    return cut.select("page_id", F.translate("__host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))


#: Labels that are public suffixes together with a country's two letters.
SECOND = ["ac", "co", "com", "edu", "gov", "net", "org"]


def levels(h: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, without its user and port.

    The suffix is the last label, or the last two where these are one of ``SECOND`` and a
    country's two letters; the domain is one label more.  An IPv4 address is its own domain.
    """
    name = F.regexp_replace(F.regexp_replace(h, "^.*@", ""), ":[0-9]*$", "")
    address = name.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
    two = name.rlike(rf"\.({'|'.join(SECOND)})\.[a-z][a-z]$")
    domain = F.when(address, name).when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return domain, F.when(address, "").when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def ruled(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) by the longest fitting rule; null where none fits.  For a few rules: they are one expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for on, under, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1], r[2])):  # the last that fits wins
        fits = ((F.col("host") == on) | F.col("host").endswith("." + on)) & F.col("path").startswith(under)
        name, verdict = F.when(fits, F.lit(on + under)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path) with ``rule`` and ``__says``, by a rule table (host, path, verdict) of any length.

    A url meets rules by equality alone: each suffix of its host at a dot meets the hosts of
    rules and the lengths of their paths, and each such start of its path meets the rules
    themselves.  So a url costs as many rows as its host has labels times the path lengths of
    those hosts' rules, however many these are.  Equal urls are judged once; of equal rules
    the greatest verdict counts.
    """
    held = rules.select(F.col("host").alias("__on"), F.col("path").alias("__under"), F.col("verdict").alias("__v")).groupBy("__on", "__under").agg(F.max("__v").alias("__v"))
    held = written(held, "url-rules")
    lengths = held.select("__on", F.length("__under").alias("__n")).distinct()
    some = written(urls.select("host", "path").distinct(), "url-distinct")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = some.select("host", "path", F.explode(suffixes).alias("__on")).join(lengths, "__on").where(F.length("path") >= F.col("__n"))
    fits = asked.withColumn("__under", F.expr("substring(path, 1, __n)")).join(held, ["__on", "__under"])
    name = F.concat("__on", "__under")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(name), name.alias("rule"), F.col("__v").alias("says"))).alias("b"))
    best = written(best.select("host", "path", "b.rule", F.col("b.says").alias("__says")), "url-ruled")
    return urls.join(best, ["host", "path"], "left")


def _strength(counts: DataFrame, n: str, k: str) -> DataFrame:
    """One row: the prior strength of a level, by moments over groups of at least two outcomes."""
    held = counts.where(F.col(n) >= 2)
    p = F.col(k) / F.col(n)
    sums = held.agg(F.count("*").alias("g"), F.sum(n).alias("sn"), F.sum(k).alias("sk"), F.sum(F.col(n) * p * p).alias("snpp"), F.sum(F.col(n) * F.col(n)).alias("snn"))
    m = F.col("sk") / F.col("sn")
    between = (F.col("snpp") - F.col("sn") * m * m - (F.col("g") - 1) * m * (1 - m)) / (F.col("sn") - F.col("snn") / F.col("sn"))
    ratio = between / (m * (1 - m))
    value = F.when((F.col("g") < 2) | (m <= 0) | (m >= 1) | (F.col("sn") - F.col("snn") / F.col("sn") <= 0), F.lit(10.0)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.when(ratio <= 0.001, F.lit(1000.0)).otherwise(1 / ratio - 1))))
    return sums.select(F.round(value, 6).alias("strength"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """``host, seen, bad, rate, lower`` of every host, from (host, bad) rows; null is no outcome.

    A host without outcomes has its domain's posterior as prior, a domain without them its
    suffix's, a suffix without them the global mean.
    ``rate`` is the posterior mean of the bad rate and ``lower`` its lower bound (``Z``
    posterior standard deviations below).
    """
    domain, suffix = levels(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn_"), F.sum("dk").alias("sk_"))
    whole = suffixes.agg(((F.sum("sk_") + 1) / (F.sum("sn_") + 2)).alias("mean0"))
    one = whole.crossJoin(_strength(suffixes, "sn_", "sk_").withColumnRenamed("strength", "s1"))
    one = one.crossJoin(_strength(domains, "dn", "dk").withColumnRenamed("strength", "s2"))
    one = one.crossJoin(_strength(hosts, "n", "k").withColumnRenamed("strength", "s3"))  # one row of global figures
    shrunk = suffixes.crossJoin(F.broadcast(one)).select("suffix", ((F.col("sk_") + F.col("s1") * F.col("mean0")) / (F.col("sn_") + F.col("s1"))).alias("mean1"), "s2", "s3")
    shrunk = domains.join(shrunk, "suffix").select("domain", "suffix", ((F.col("dk") + F.col("s2") * F.col("mean1")) / (F.col("dn") + F.col("s2"))).alias("mean2"), "s3")
    a = F.col("k") + F.col("s3") * F.col("mean2")
    total = F.col("n") + F.col("s3")
    rate = a / total
    return hosts.join(shrunk, ["domain", "suffix"]).select("host", F.col("n").alias("seen"), F.col("k").alias("bad"), rate.alias("rate"), F.greatest(F.lit(0.0), rate - Z * F.sqrt(rate * (1 - rate) / (total + 1))).alias("lower"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, limit: float = BAD_RATE) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page.

    ``rules`` is a list, or a table (host, path, verdict) of any length, as which a list of more
    than ``MAX_INLINE_RULES`` is taken too.  ``outcomes`` has (page_id, bad).  A page that no rule fits is blocked where its host's
    lower bound exceeds ``limit``, and allowed otherwise; hosts without labelled pages are
    judged by their domain's, suffix's and the global outcomes.  An empty host (a null url, or
    one without ``://``) has no reputation and is allowed.  Repeated pages are judged one by
    one, null ids as pages without a label; empty tables give no rows; extra columns are ignored.
    """
    urls = parsed(pages)
    known = outcomes.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("bigint").alias("bad"))
    bad_hosts = reputation(urls.where("host <> ''").join(known, "page_id", "left").select("host", "bad")).where(F.round("lower", 9) > limit).select("host", F.lit(True).alias("__bad"))
    if isinstance(rules, list) and len(rules) > MAX_INLINE_RULES:
        rules = pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
    if isinstance(rules, list):
        name, verdict = ruled(rules)
        by_rule = urls.withColumn("rule", name).withColumn("__says", verdict)
    else:
        by_rule = joined_rules(urls, rules)
    out = by_rule.join(bad_hosts, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("__says", F.when(F.col("__bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


ORACLE = """
WITH a AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages
), b AS (SELECT page_id, after, regexp_extract(after, '^([^/?#]*)', 1) AS h FROM a
), u AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(after, length(h) + 1), '^([^?#]*)', 1) AS path FROM b
), o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), hosts AS (
  SELECT host, CASE WHEN ip THEN name WHEN two THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE array_to_string(string_split(name, '.')[-2:], '.') END AS domain,
         CASE WHEN ip THEN '' WHEN two THEN array_to_string(string_split(name, '.')[-2:], '.') ELSE string_split(name, '.')[-1] END AS suffix, n, k
  FROM (SELECT *, regexp_matches(name, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') AS ip, regexp_matches(name, '\\.(ac|co|com|edu|gov|net|org)\\.[a-z][a-z]$') AS two
    FROM (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, count(bad) AS n, coalesce(sum(bad), 0) AS k
      FROM u LEFT JOIN o USING (page_id) WHERE host <> '' GROUP BY 1, 2))
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2
), suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY 1
), lv AS (
  SELECT 1 AS l, n, k FROM suffixes WHERE n >= 2 UNION ALL SELECT 2, n, k FROM domains WHERE n >= 2 UNION ALL SELECT 3, n, k FROM hosts WHERE n >= 2
), m AS (
  SELECT l, count(*) AS g, sum(n)::DOUBLE AS sn, sum(k)::DOUBLE AS sk, sum(n * (k / n) * (k / n)) AS snpp, sum(n::DOUBLE * n) AS snn FROM lv GROUP BY l
), w AS (
  SELECT l, g, sk / sn AS m, sn - snn / sn AS den, (snpp - sn * (sk / sn) * (sk / sn) - (g - 1) * (sk / sn) * (1 - sk / sn)) AS num FROM m
), st AS (
  SELECT l, round(CASE WHEN g < 2 OR m <= 0 OR m >= 1 OR den <= 0 THEN 10.0
    WHEN num / den / (m * (1 - m)) <= 0.001 THEN 1000.0
    ELSE greatest(1.0, least(1000.0, 1 / (num / den / (m * (1 - m))) - 1)) END, 6) AS s FROM w
), s AS (SELECT coalesce(max(s) FILTER (l = 1), 10.0) AS s1, coalesce(max(s) FILTER (l = 2), 10.0) AS s2, coalesce(max(s) FILTER (l = 3), 10.0) AS s3 FROM st
), g AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS mean0 FROM suffixes
), p1 AS (SELECT suffix, (k + s1 * mean0) / (n + s1) AS mean1 FROM suffixes, s, g
), p2 AS (SELECT d.domain, d.suffix, (d.k + s2 * mean1) / (d.n + s2) AS mean2 FROM domains d JOIN p1 USING (suffix), s
), p3 AS (
  SELECT host, (h.k + s3 * mean2) / (h.n + s3) AS rate, h.n + s3 AS total FROM hosts h JOIN p2 USING (domain, suffix), s
), bad AS (SELECT host FROM p3 WHERE round(greatest(0.0, rate - 1.645 * sqrt(rate * (1 - rate) / (total + 1))), 9) > 0.5
), r AS (
  SELECT page_id, u.host, path, CASE
    WHEN (u.host = 'example.net' OR u.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (u.host = 'example.com' OR u.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (u.host = 'org' OR u.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (u.host = 'net' OR u.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    bad.host IS NOT NULL AS is_bad
  FROM u LEFT JOIN bad ON u.host = bad.host
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR is_bad THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
