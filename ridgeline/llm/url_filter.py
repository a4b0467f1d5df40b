"""URL filters: allow and block rules, and an empirical-Bayes reputation of hosts for what no rule covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize, read_table, split_hot_join

#: (host, path, verdict) of each rule; a rule's text is host + path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Standard deviations below the mean of the posterior where its lower bound is taken.
SIGMAS = 1.645
#: A host is blocked when even the lower bound of its rate of failed pages is above the bar: the rate whose odds are LIFT times those of all
#: pages, and LEAST_BAR at least.
LIFT, LEAST_BAR = 3.0, 0.1
#: Strength of a prior, in pages. The most is what a host's own pages must outweigh, however alike the other hosts are.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 20.0
#: A page fails when this share of its characters is junk symbols.
JUNK_SHARE = 0.02
#: ... or when its address has one of these words, between characters other than letters. Fixed values.
TELLING = ("casino", "casinos", "poker", "bet", "bets", "betting", "pills", "viagra", "cialis", "porn", "xxx", "adult", "escort", "spam", "ads", "adserver", "clickbait", "warez", "torrent", "payday", "loans", "replica")
_TELLING = f"(^|[^a-z])({'|'.join(TELLING)})([^a-z]|$)"
#: Second labels under which a two-letter country's domains are registered, so that co.uk is a suffix. Fixed values.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ne", "net", "or", "org")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: what follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased;
    path: what follows that up to "?", "#" or the end. Null or no "://": both empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    given = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(given, pattern, 1), _UPPER, _LOWER), F.regexp_extract(given, pattern, 2)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: on its host and all subdomains, where the path starts with the rule's. Null where none
    does; of two as long, a block comes first. The rules are constants of the plan."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def failed_page(host: Column, path: Column, html: Column) -> Column:
    """Outcome of a page, 1 if it fails: an empty page, junk symbols above JUNK_SHARE of it, or a telling word in its host or path."""
    text = F.coalesce(html, F.lit(""))
    junk = F.length(text) - F.length(F.translate(text, "#*$%|", ""))
    telling = F.translate(F.concat(host, path), _UPPER, _LOWER).rlike(_TELLING)
    return F.when((junk >= JUNK_SHARE * F.length(text)) | telling, 1).otherwise(0)


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """(suffix, registered domain): the last label and the last two, one more each where SECOND_LEVEL stands before a two-letter label."""
    deep = host.rlike(rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")
    return F.when(deep, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1)), F.when(deep, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength() -> Column:
    """Pages that a parent's rate `above` is worth among its own children, by moments: with n pages and f failures
    each, the excess of sum((f - n m)^2) over the binomial's says how much children differ."""
    m = F.col("above")
    spread = F.sum(F.pow(F.col("failed") - F.col("pages") * m, F.lit(2)))
    noise = F.sum(F.col("pages") * m * (1 - m))
    room = F.sum(F.col("pages") * (F.col("pages") - 1) * m * (1 - m))
    rho = F.greatest(F.lit(0.0), (spread - noise) / F.nullif(room, F.lit(0.0)))
    return F.least(F.lit(MAX_STRENGTH), F.greatest(F.lit(MIN_STRENGTH), F.coalesce((1 - rho) / F.nullif(rho, F.lit(0.0)), F.lit(MAX_STRENGTH))))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, pages, failed, mean, bound, bar, n) from outcomes (host, failed 0/1 or null for unlabelled).

    A beta-binomial chain: the suffix's rate is shrunk towards the whole's, the registered domain's towards its
    suffix's, the host's towards its domain's, each with the strength that moments over the parent's children give. bound is the
    lower bound of the host's posterior rate of failures, SIGMAS standard deviations below its mean; bar is the same for all hosts. Pages are
    counted per host first, so a hot host is one row from there on, and hosts of a hot domain or suffix stay where they are when they
    meet their parent. n counts all rows, labelled or not.
    """
    label = F.col("failed")
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.count(label).alias("pages"), F.coalesce(F.sum(label), F.lit(0)).alias("failed"))
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = materialize(hosts.withColumn("suffix", suffix).withColumn("domain", domain), "hosts")
    count = [F.sum("pages").alias("pages"), F.sum("failed").alias("failed")]
    domains = materialize(hosts.groupBy("suffix", "domain").agg(*count), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(*count), "suffixes")
    whole = suffixes.agg(*count).first()
    above = ((whole["failed"] or 0) + 1.0) / ((whole["pages"] or 0) + 2.0)
    odds = LIFT * above / (1 - above)

    def shrunk(level: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
        """level with the parent's mean `above`, its `strength` and the level's own `mean`. parents: keys, above."""
        sizes = level.groupBy(*keys).agg(F.count("*").alias("_children"))
        known = split_hot_join(level, sizes.join(parents, keys), keys, "_children", level.count())
        strengths = known.groupBy(*keys).agg(F.first("_children").alias("_children"), _strength().alias("strength"))
        ready = split_hot_join(known.drop("_children"), materialize(strengths, "strengths"), keys, "_children", level.count())
        return materialize(ready.withColumn("mean", (F.col("failed") + F.col("above") * F.col("strength")) / (F.col("pages") + F.col("strength"))), "shrunk")

    top = suffixes.withColumn("above", F.lit(above))
    strength = F.lit(top.agg(_strength().alias("strength")).first()["strength"])
    by_suffix = top.select("suffix", ((F.col("failed") + above * strength) / (F.col("pages") + strength)).alias("above"))
    by_domain = shrunk(domains, by_suffix, ["suffix"]).select("suffix", "domain", F.col("mean").alias("above"))
    by_host = shrunk(hosts, by_domain, ["suffix", "domain"])
    bound = F.col("mean") - SIGMAS * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("pages") + F.col("strength") + 1))
    return by_host.select("host", "pages", "failed", "mean", bound.alias("bound"), F.lit(max(LEAST_BAR, odds / (1 + odds))).alias("bar"), "n")


def filter_urls(pages: DataFrame, *, rules: tuple[tuple[str, str, str], ...] = RULES, outcome: Column | None = None, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """One row per row of pages: (page_id, host, path, rule, verdict, bound).

    outcome: 1 for a failed page, 0 for a good one, null for an unlabelled one; by default failed_page of the address and the column html.
    Where no rule fits, the verdict is block if the host's bound is above the bar, else allow. Hosts with few pages lean
    on their domain and suffix, so one bad page doesn't block a host. Null or malformed urls share the empty host, null html is an empty
    page; null ids and repeated rows are carried; whole texts are read, however long; other columns are ignored; an empty table gives no row.
    """
    host, path = split_url(F.col(url).cast("string"))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), (failed_page(host, path, F.col("html")) if outcome is None else outcome).alias("failed"))
    rows = materialize(rows, "urls")
    reputation = materialize(host_reputation(rows), "reputation")
    joined = split_hot_join(rows.drop("failed"), reputation.select("host", "bound", "bar", "n"), ["host"], "n", rows.count())
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > F.col("bar"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("bound", 6).alias("bound"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages")).drop("bound")


def _level_sql(name: str, keys: str) -> str:
    """Strengths by parent and shrunk means of a level whose rows hold pages, failed and the parent's mean m."""
    return f"""{name}1 AS (SELECT {keys}, greatest(0, (sum((failed - pages * m) ** 2) - sum(pages * m * (1 - m))) / nullif(sum(pages * (pages - 1) * m * (1 - m)), 0)) AS rho FROM {name}0 GROUP BY {keys}),
{name}2 AS (SELECT {keys}, least({MAX_STRENGTH}, greatest({MIN_STRENGTH}, coalesce((1 - rho) / nullif(rho, 0), {MAX_STRENGTH})))::DOUBLE AS k FROM {name}1)"""


_DEEP = rf"regexp_matches(host, '(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$')"
_LABELS = "array_to_string(list_slice(string_split(host, '.'), CASE WHEN {deep} THEN {far} ELSE {near} END, -1), '.')"

OP3_SQL = f"""
WITH cut AS (
  SELECT page_id, strpos(coalesce(url, ''), '://') AS pos, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), rest AS (SELECT page_id, html, CASE WHEN pos = 0 THEN '' ELSE substr(url, pos + 3) END AS rest FROM cut),
part AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), judged AS (
  SELECT page_id, host, path, CASE WHEN length(html) - length(translate(html, '#*$%|', '')) >= {JUNK_SHARE} * length(html)
    OR regexp_matches(translate(host || path, '{_UPPER}', '{_LOWER}'), '{_TELLING}') THEN 1 ELSE 0 END AS failed FROM part
), hosts AS (
  SELECT host, count(*) AS pages, sum(failed) AS failed, {_LABELS.format(deep=_DEEP, far=-2, near=-1)} AS suffix, {_LABELS.format(deep=_DEEP, far=-3, near=-2)} AS domain FROM judged GROUP BY host
), domains AS (SELECT suffix, domain, sum(pages) AS pages, sum(failed) AS failed FROM hosts GROUP BY ALL),
suffixes AS (SELECT 0 AS root, suffix, sum(pages) AS pages, sum(failed) AS failed FROM domains GROUP BY ALL),
whole AS (SELECT (coalesce(sum(failed), 0) + 1.0::DOUBLE) / (coalesce(sum(pages), 0) + 2.0::DOUBLE) AS m FROM suffixes),
bar AS (SELECT greatest({LEAST_BAR}, {LIFT} * m / (1 - m) / (1 + {LIFT} * m / (1 - m)))::DOUBLE AS bar FROM whole),
s0 AS (SELECT suffixes.*, m FROM suffixes, whole), {_level_sql("s", "root")},
s3 AS (SELECT suffix, (failed + m * k) / (pages + k) AS m FROM s0 JOIN s2 USING (root)),
d0 AS (SELECT domains.*, s3.m FROM domains JOIN s3 USING (suffix)), {_level_sql("d", "suffix")},
d3 AS (SELECT suffix, domain, (failed + m * k) / (pages + k) AS m FROM d0 JOIN d2 USING (suffix)),
h0 AS (SELECT hosts.*, d3.m FROM hosts JOIN d3 USING (suffix, domain)), {_level_sql("h", "suffix, domain")},
h3 AS (SELECT host, pages + k AS total, (failed + m * k) / (pages + k) AS mean FROM h0 JOIN h2 USING (suffix, domain)),
h4 AS (SELECT host, mean - {SIGMAS} * sqrt(mean * (1 - mean) / (total + 1)) AS bound FROM h3),
ruled AS (
  SELECT page_id, host, path, bound, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM judged JOIN h4 USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN bound > bar THEN 'block' ELSE 'allow' END AS verdict FROM ruled, bar
"""
