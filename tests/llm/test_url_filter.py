from pyspark.sql import functions as F

from rowmesh.llm import common, url_filter

SF = "/root/testdata/sf0.01"
URLS = [
    (1, "https://www.Example.COM/en/x?a=1#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    (2, "http://blog.example.com/en/", "blog.example.com", "/en/", "example.com/en/", "block"),
    (3, "http://example.com/de", "example.com", "/de", "com/", "allow"),
    (4, "http://example.com", "example.com", "", None, "allow"),
    (5, "http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
    (6, "http://anet/es/1", "anet", "/es/1", None, "allow"),
    (7, "ftp://net/fr/", "net", "/fr/", "net/fr/", "block"),
    (8, "no scheme/en/", "", "", None, "allow"),
    (9, None, "", "", None, "allow"),
    (10, "", "", "", None, "allow"),
    (11, "http://É.Net?x=://b.com/", "É.net", "", None, "allow"),
    (12, "https://m.spam-farm.org/en/7/?utm_source=a&b=2&a=1", "m.spam-farm.org", "/en/7/", None, "block"),
    (13, "http://spam-farm.org:80/en/7?a=1&b=2#top", "spam-farm.org:80", "/en/7", None, "block"),
    (14, "http://spam-farm.org/en/8", "spam-farm.org", "/en/8", None, "allow"),
    (14, "http://spam-farm.org/en/7?b=2&a=1", "spam-farm.org", "/en/7", None, "block"),
]


def test_rules_and_listing(spark):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u, *_ in URLS], "page_id bigint, url string, host string, verdict string")
    listed = spark.createDataFrame([("spam-farm.org/en/7?a=1&b=2",), ("spam-farm.org/en/7?a=1&b=2",), (None,), ("",)], "url string")
    for limit in (1 << 20, 0):  # broadcast filter, and the filter as a join
        got = url_filter.filter_urls(pages, listed, broadcast_bytes=limit)
        rows = sorted((r["row"]["page_id"], r["row"]["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.where("row.url is not null").collect())
        assert rows == sorted(x for x in URLS if x[1] is not None)
        assert [tuple(r) for r in got.where("row.url is null").select("host", "path", "rule", "verdict").collect()] == [("", "", None, "allow")]


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(4000).select(F.concat(F.lit("h/"), "id").alias("url"))
    blocks = 4000 * 16 // 512
    bloom = url_filter.bloom_blocks(listed, blocks)
    probe = spark.range(12000).select("id", F.concat(F.lit("h/"), "id").alias("url")).withColumn("block", F.pmod(F.xxhash64("url"), F.lit(blocks))).join(bloom, "block", "left")
    passes = F.lit(True)
    for i in range(url_filter.WORDS):
        passes = passes & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(url_filter._bit(F.col("url"), i)) != 0)
    hits = {r.id for r in probe.where(passes).collect()}
    assert hits >= set(range(4000)) and len(hits) < 4000 + 8000 * 0.02


def test_nothing_listed_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id bigint, url string")
    none = spark.createDataFrame([], "url string")
    assert [r.verdict for r in url_filter.filter_urls(pages, none).collect()] == ["allow"]
    assert url_filter.filter_urls(pages.where("false"), none).count() == 0


def test_only_listed_urls_are_blocked_whatever_passes_the_filter(spark, monkeypatch):
    """A filter that lets everything pass changes nothing, one that lets nothing pass leaves all allowed."""
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.h.org/p/"), "id", F.lit("/?utm_source=x&b=1#top")).alias("url"))
    listed = pages.where("page_id % 3 = 0").select(url_filter.canonical(F.regexp_replace("url", "https://www", "http://m")).alias("url"))
    want = {i: "block" if i % 3 == 0 else "allow" for i in range(300)}
    verdicts = lambda: {r["row"]["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, listed).collect()}
    assert verdicts() == want
    blocks = url_filter.bloom_blocks
    monkeypatch.setattr(url_filter, "bloom_blocks", lambda df, n: blocks(df, n).select("block", *(F.lit(-1).cast("long").alias(f"w{i}") for i in range(url_filter.WORDS))))
    assert verdicts() == want
    monkeypatch.setattr(url_filter, "bloom_blocks", lambda df, n: blocks(df, n).select("block", *(F.lit(0).cast("long").alias(f"w{i}") for i in range(url_filter.WORDS))))
    assert set(verdicts().values()) == {"allow"}


def test_long_urls_and_equally_long_rules(spark):
    rules = (("block", "com", "/en/"), ("allow", "xx.com", "/"), ("allow", "z.com", "/a"), ("block", "com", "/abc"))
    urls = ["http://xx.com/en/" + "y" * 200_000, "http://xx.com/en/", "http://a.com/en/", "http://z.com/abc", "http://y.com/" + "z/" * 100_000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = {r["row"]["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.listing(pages.withColumn("html", F.lit("<title>###"))), rules=rules).collect()}
    assert got == {0: ("xx.com/", "allow"), 1: ("xx.com/", "allow"), 2: ("com/en/", "block"), 3: ("z.com/a", "allow"), 4: (None, "block")}


def test_the_query_blocks_by_the_url_and_not_by_the_host(spark):
    pages = common.table(spark, SF, "pages")
    labels = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, url_filter.LISTED_LABELS)))
    got = url_filter.query(spark, SF).where("rule is null").select("host", "verdict", labels.alias("labelled"))
    both = {(r.labelled, r.verdict) for r in got.collect()}
    assert {(False, "allow"), (False, "block")} <= both and (True, "allow") not in both
    assert url_filter.query(spark, SF).count() == pages.count()
