"""URL filter: host and path rules first, then a listing of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks of eight 64-bit words. A URL's hash picks one block and one bit in each word, so a probe
reads a single row. Its size follows from the count of listed URLs: below ``broadcast_bytes`` it is broadcast, beyond
that the probe is an ordinary join on the block. Only what passes the filter reaches the exact join with the listing,
which removes the false positives; all other pages pass by without any shuffle.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values: (verdict, host, path) of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Labels of hosts and a pattern of titles whose pages make up the listing of the registered query.
LISTED_LABELS = ("adult-x", "casino-win", "free-bets", "spam-farm")
JUNK_TITLE = r"<title>[^<]*(%%%|###|\*\*\*|\$\$\$)"
#: Query parameters that do not change what a URL shows.
TRACKING = "^(utm_|ref=|fbclid=|gclid=)"

BITS_PER_URL = 16
WORDS = 8
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty for null or without ``://``."""
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, ``m.`` or a default port, path without closing slashes, other query parameters in order."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), ":(80|443)$", "")
    query = F.coalesce(F.regexp_extract(url, r"://[^/?#]*[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict; null where none fits. Of equally long ones that of the longer
    host counts, then the last."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _bit(url: Column, word: int) -> Column:
    at = F.shiftrightunsigned(F.xxhash64(F.lit("bit"), url), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 ... w7) of the column ``url``."""
    block = F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block")
    return listed.groupBy(block).agg(*(F.bit_or(_bit(F.col("url"), i)).alias(f"w{i}") for i in range(WORDS)))


def filter_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url", rules=RULES, bits_per_url: int = BITS_PER_URL, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each row of ``pages`` as (row, host, path, rule, listed, verdict); row is a struct of all its columns.

    ``listed`` has a column ``url`` of canonical URLs; nulls, empty ones and repeats in it do nothing. A fitting rule
    decides; else a page is blocked if its canonical URL is listed and allowed otherwise. Null URLs and those without
    ``://`` have an empty host and path, fit no rule and are allowed. URLs of any length are judged whole, and repeated
    rows each. Empty tables give empty results."""
    listed = common.stored(listed.where("url is not null and url <> ''").select("url").distinct(), "listed-urls")
    blocks = max(1, ceil(listed.count() * bits_per_url / (64 * WORDS)))
    bloom = bloom_blocks(listed, blocks)
    if blocks * 8 * (WORDS + 1) <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    url = F.col(url_col)
    seen = pages.select(F.struct(*(pages[c] for c in pages.columns)).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.select("*", rule.alias("rule"), verdict.alias("ruled"))
    out = ["row", "host", "path", "rule", "listed", "verdict"]
    ruled = seen.where("rule is not null").select("*", F.lit(None).cast("boolean").alias("listed"), F.col("ruled").alias("verdict"))
    free = seen.where("rule is null").withColumn("block", F.pmod(F.xxhash64("canonical"), F.lit(blocks))).join(bloom, "block", "left")
    passes = F.lit(True)
    for i in range(WORDS):
        passes = passes & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(_bit(F.col("canonical"), i)) != 0)
    clean = free.where(~passes).withColumn("listed", F.lit(False))
    exact = listed.select(F.col("url").alias("canonical"), F.lit(True).alias("found"))
    maybe = free.where(passes).join(exact, "canonical", "left").withColumn("listed", F.coalesce("found", F.lit(False)))
    verdict = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select(out).union(clean.withColumn("verdict", verdict).select(out)).union(maybe.withColumn("verdict", verdict).select(out))


def listing(pages: DataFrame) -> DataFrame:
    """Canonical URLs of all pages on hosts that carry a listed label, and of those with a junk title on any host."""
    listed = F.arrays_overlap(F.split(host_of(F.col("url")), r"\."), F.array(*map(F.lit, LISTED_LABELS)))
    return pages.where(listed | F.coalesce(F.col("html").rlike(JUNK_TITLE), F.lit(False))).select(canonical(F.col("url")).alias("url"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the verdict on every page."""
    pages = common.table(spark, sf_dir, "pages")
    return filter_urls(pages.select("page_id", "url"), listing(pages)).select("row.page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(regexp_matches(html, '<title>[^<]*(%%%|###|\*\*\*|\$\$\$)'), FALSE) AS junk,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '://[^/?#]*[^?#]*\?([^#]*)', 1), '') AS query
  FROM pages),
c AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|ref=|fbclid=|gclid=)'))), '&') AS kept FROM p),
u AS (
  SELECT *, regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
      || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical FROM c),
listed AS (
  SELECT DISTINCT canonical FROM u
  WHERE (junk OR list_has_any(string_split(host, '.'), ['adult-x', 'casino-win', 'free-bets', 'spam-farm'])) AND canonical <> ''),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN listed ON r.canonical = listed.canonical
"""
