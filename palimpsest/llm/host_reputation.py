"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes are counted by host, registered domain and suffix. The share of
good pages of a suffix is shrunk to that of all pages, a domain's to its suffix's and a host's to its
domain's, each through a beta-binomial prior whose strength M is estimated by moments over all groups of the
level: with m_i the parent's posterior mean and p_i = k_i / n_i,

    S = sum n_i (p_i - m_i)^2 / sum n_i,  V = sum n_i m_i (1 - m_i) / sum n_i,  B = sum m_i (1 - m_i) / sum n_i,
    M = (V - B) / (S - B) - 1, from 1 to 1000; 1000 if S <= B, 10 without outcomes.

The posterior of a group is Beta(k + M m, n - k + M (1 - m)). A host is blocked if the upper bound of its
good share, mean + Z standard deviations, is below HALF.

Rules come first: the longest rule (host and path) whose host is the page's or a parent of it and
whose path begins the page's decides. In the query these decisions are the labelled outcomes: pages that a
rule allows are good, those that it blocks bad.

Groups go by the bare host, without user and port. A suffix is the last label, or the last two if the last has two letters (a country) and the one before is
one of GENERIC, as in co.uk; a registered domain is the suffix and one label more. An IP address is its own domain, of the suffix "ip".

Only pages that no rule decides meet the blocked hosts, which are the only ones that can change their verdict; hosts are counted once and kept.

Defined cases: a null url, or one without ://, has an empty host and path, and the empty host is a group of its own; repeated rows
count each; a page with a null id is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import _exchange as X

Z, HALF = 1.645, 0.5
#: The rules of the query, host and path, and whether they allow.
RULES = {"org/": True, "example.org/es/": False, "example.org/en/1": False, "com/fr/": True, "com/de/": False}
#: Labels under a country that are no one's domain.
GENERIC = "co|com|net|org|ac|edu|gov|gob|mil|or|ne|go"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, bool]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = (host == name) | host.endswith("." + name)
        out = F.when(fits & path.startswith(slash + rest), F.lit(rule)).otherwise(out)
    return out


#: Of a bare host: an address, its suffix (the longer alternative is tried first), its registered domain.
ADDRESS = r"^(?:[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+|\[.*)$"
SUFFIX = rf"((?:^|[.])(?:{GENERIC})[.][a-z][a-z]|[^.]*)$"


def bare(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    """The suffix of a bare host."""
    return F.when(host.rlike(ADDRESS), "ip").otherwise(F.regexp_replace(F.regexp_extract(host, SUFFIX, 1), "^[.]", ""))


def domain_of(host: Column) -> Column:
    """The registered domain of a bare host."""
    ahead = F.substr(host, F.lit(1), F.greatest(F.length(host) - F.length(suffix_of(host)) - 1, F.lit(0)))
    return F.when(host.rlike(ADDRESS), host).otherwise(F.concat(F.regexp_extract(ahead, "([^.]*)$", 1), F.lit("."), suffix_of(host)))


def posterior(level: DataFrame) -> DataFrame:
    """level: groups with n, k and the parent's mean m; adds a and b of the posterior."""
    v = F.col("m") * (1 - F.col("m"))
    sums = level.agg(
        F.sum(F.col("n")).alias("held"),
        F.sum(F.when(F.col("n") > 0, F.pow(F.col("k") - F.col("n") * F.col("m"), 2) / F.col("n"))).alias("s"),
        F.sum(F.col("n") * v).alias("v"),
        F.sum(F.when(F.col("n") > 0, v)).alias("b"),
    )
    strength = F.when(F.coalesce(F.col("held"), F.lit(0)) == 0, 10.0).when(F.col("s") <= F.col("b"), 1000.0).otherwise(F.least(F.greatest((F.col("v") - F.col("b")) / (F.col("s") - F.col("b")) - 1, F.lit(1.0)), F.lit(1000.0)))
    strong = sums.select(strength.alias("strength"))  # one row
    return level.join(F.broadcast(strong)).withColumn("a", F.col("k") + F.col("strength") * F.col("m")).withColumn("b", F.col("n") - F.col("k") + F.col("strength") * (1 - F.col("m"))).drop("strength")


def reputation(pages: DataFrame, z: float = Z, half: float = HALF) -> DataFrame:
    """host, n_labelled, mean, upper, blocked of every host; pages has host and good (1, 0 or null for unlabelled)."""
    hosts = pages.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k")).withColumn("bare", bare(F.col("host")))
    hosts = X.checkpoint(hosts.select("host", domain_of(F.col("bare")).alias("domain"), suffix_of(F.col("bare")).alias("suffix"), "n", "k"))  # one row a host, read by every level
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m"))  # one row
    of_suffix = posterior(suffixes.join(F.broadcast(overall))).select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
    of_domain = posterior(domains.join(of_suffix, "suffix")).select("suffix", "domain", (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
    of_host = posterior(hosts.join(of_domain, ["suffix", "domain"]))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    upper = mean + z * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    return of_host.select("host", F.col("n").alias("n_labelled"), mean.alias("mean"), upper.alias("upper"), (upper < half).alias("blocked"))


def judged(pages: DataFrame, rules: dict[str, bool] = RULES, ident: str = "page_id", url: str = "url", outcome: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict. outcome: 1 good, 0 bad, null unlabelled; what the rules decide, if not given. reputation() has the hosts' means and bounds."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule = rule_of(host, path, rules)
    good = rule.isin([r for r, ok in rules.items() if ok]).cast("int")
    rows = pages.select(F.col(ident).alias("page_id"), host.alias("host"), path.alias("path"), rule.alias("rule"), good.alias("allowed"), (good if outcome is None else outcome).alias("good"))
    bad = reputation(rows).where("blocked").select("host", F.lit(True).alias("blocked"))
    # a page that a rule decides meets no host: its key is null
    asked = rows.withColumn("open", F.when(F.col("allowed").isNull(), F.col("host")))
    found = asked.join(bad.withColumnRenamed("host", "open"), "open", "left")
    verdict = F.when(F.col("allowed") == 1, "allow").when((F.col("allowed") == 0) | F.col("blocked"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op7_host_reputation(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


_LEVEL = """{name}_s AS (
  SELECT CASE WHEN coalesce(sum(n), 0) = 0 THEN 10.0
    WHEN sum((k - n * m) * (k - n * m) / n) FILTER (n > 0) <= sum(m * (1 - m)) FILTER (n > 0) THEN 1000.0
    ELSE least(greatest((sum(n * m * (1 - m)) - sum(m * (1 - m)) FILTER (n > 0)) / (sum((k - n * m) * (k - n * m) / n) FILTER (n > 0) - sum(m * (1 - m)) FILTER (n > 0)) - 1, 1.0), 1000.0) END AS strength FROM {name}),
{name}_p AS (SELECT {keys}, k + strength * m AS a, n - k + strength * (1 - m) AS b FROM {name}, {name}_s)"""
SQL = f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fits AS (
  SELECT *, host = 'org' OR ends_with(host, '.org') AS in_org, host = 'com' OR ends_with(host, '.com') AS in_com, host = 'example.org' OR ends_with(host, '.example.org') AS in_example FROM u),
r AS (
  SELECT page_id, host, path, CASE WHEN in_example AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN in_example AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN in_com AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN in_com AND starts_with(path, '/de/') THEN 'com/de/' WHEN in_org AND starts_with(path, '/') THEN 'org/' END AS rule FROM fits),
g AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS good FROM r),
h0 AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare, count(good) AS n, coalesce(sum(good), 0) AS k FROM g GROUP BY host),
h1 AS (
  SELECT *, CASE WHEN regexp_matches(bare, '^([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+|\\[.*)$') THEN 'ip' WHEN regexp_matches(bare, '(^|[.])({GENERIC})[.][a-z][a-z]$') THEN regexp_extract(bare, '[^.]*[.][^.]*$', 0) ELSE regexp_extract(bare, '[^.]*$', 0) END AS suffix FROM h0),
h AS (
  SELECT host, suffix, n, k, CASE WHEN suffix = 'ip' THEN bare ELSE regexp_extract(left(bare, greatest(length(bare) - length(suffix) - 1, 0)), '[^.]*$', 0) || '.' || suffix END AS domain FROM h1),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
t AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
o AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS m FROM t),
l1 AS (SELECT suffix, n, k, m FROM t, o),
{_LEVEL.format(name="l1", keys="suffix")},
l2 AS (SELECT d.suffix, domain, n, k, a / (a + b) AS m FROM d JOIN l1_p USING (suffix)),
{_LEVEL.format(name="l2", keys="suffix, domain")},
l3 AS (SELECT host, n, k, a / (a + b) AS m FROM h JOIN l2_p USING (suffix, domain)),
{_LEVEL.format(name="l3", keys="host")},
bound AS (SELECT host, a / (a + b) + {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS upper FROM l3_p)
SELECT page_id, host, path, rule, CASE WHEN good = 1 THEN 'allow' WHEN good = 0 THEN 'block' WHEN upper < {HALF} THEN 'block' ELSE 'allow' END AS verdict
FROM g JOIN bound USING (host)
"""
