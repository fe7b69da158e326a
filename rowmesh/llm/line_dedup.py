"""Line deduplication over levelled sorted runs of line hashes.

Lines become 128-bit hashes once. The hashes arrive in batches of whole documents, each condensed to one row for each key
(documents, largest id). A batch is merge-anti-joined against the runs: keys that no run holds become a run of their
own, the others are later sightings. So a key is in one run only, that of the batch which brought it. When a level holds
``fanout`` runs they are merged into one of the next level, and a batch meets few runs however many came before.

Batches and runs are tables bucketed and sorted by key, with as many buckets: the joins and the merges have no exchange.
The anti-join decides what is crowded. A run's count holds but for the keys with later sightings, which add theirs; all
keys seen in one batch alone are never summed again.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import Scope
from . import common

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 3
#: Rows of a bucket: about so many, and at least so many where there are more tasks than work.
BUCKET_ROWS = 16_000_000
LEAST_BUCKET_ROWS = 50_000


class LineRuns:
    """Levelled runs of (a, b, n, last): key, documents of the batch that brought it and the largest of their ids.

    ``buckets`` is that of the batches too, else every join deals them out anew."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int = 8):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[DataFrame]] = []
        self.again: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose key no run holds: one merge-anti-join for each run."""
        return reduce(lambda left, run: left.join(run.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), self.runs(), batch)

    def add(self, batch: DataFrame) -> None:
        """``batch(a, b, n, last)``, one row for each key."""
        batch = batch.select("a", "b", "n", "last")
        self.again += [batch.join(run.select("a", "b").hint("merge"), ["a", "b"], "left_semi") for run in self.runs()]
        self._put(0, self.unseen(batch))

    def _put(self, level: int, rows: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(common.bucketed(rows, ["a", "b"], self.buckets, f"run_{level}"))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, reduce(DataFrame.union, runs))  # no key is in two of them

    def crowded(self, min_docs: int) -> DataFrame:
        """(a, b, n, last) of the keys that ``min_docs`` documents hold."""
        first = reduce(DataFrame.union, self.runs())
        if not self.again:
            return first.where(F.col("n") >= min_docs)
        later = reduce(DataFrame.union, self.again).groupBy("a", "b").agg(F.sum("n").alias("more"), F.max("last").alias("later"))
        both = first.join(later, ["a", "b"], "left").select("a", "b", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last", "later").alias("last"))
        return both.where(F.col("n") >= min_docs)


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, t, pos, a, b) of each line whose key has ``min_chars`` code points; t tells rows of one id apart."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    trimmed = lines.select("id", "t", "pos", F.btrim("line", F.lit(common.BLANKS)).alias("key")).where(F.char_length("key") >= min_chars)
    key = common.ascii_lower(F.col("key"))
    return trimmed.select("id", "t", "pos", F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """Each row of ``docs`` as (row, n_lines, n_dropped, kept): row is a struct of all its columns, so no name can clash.

    A line's key is the line without blanks at either end, A-Z lower-cased. Keys of ``min_chars`` code points or more
    found under ``min_docs`` different ids or more lose all their lines but those under the largest id that holds them.
    Null and empty texts are one empty line. Rows that repeat an id are one document for counting, each keeps its own
    text; rows with a null id are together one document below all others. An empty table gives an empty result."""
    spark = docs.sparkSession
    with Scope(spark):
        keys = common.stored(line_keys(docs, id_col, text_col, min_chars), "line-keys")
        rows = keys.count()
        buckets = min(100_000, max(1, min(spark.sparkContext.defaultParallelism, ceil(rows / LEAST_BUCKET_ROWS)), ceil(rows / BUCKET_ROWS)))
        dealt = keys.select("id", "a", "b").distinct().withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
        dealt = dealt.groupBy("a", "b", "batch").agg(F.count("*").alias("n"), F.max("id").alias("last"))
        with Scope(spark) as scope:
            dealt, runs = common.bucketed(dealt, ["a", "b"], buckets, "line_batches", partition_by="batch"), LineRuns(spark, fanout, buckets)
            for i in range(batches):
                runs.add(dealt.where(F.col("batch") == i))
            # stored, so that both sides of the next join are plain shuffles and the partition of a very common line can be split
            crowded = common.stored(runs.crowded(min_docs).select("a", "b", "last"), "crowded-lines")
            scope.discard(keep=1)
    drops = keys.join(crowded, ["a", "b"]).where(~F.col("id").eqNullSafe(F.col("last"))).groupBy("id", "t").agg(F.collect_set("pos").alias("gone"))
    drops = drops.select(F.col("id").alias("drop_id"), F.col("t").alias("drop_t"), "gone").hint("shuffle_hash")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("t", F.xxhash64("text")).join(drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("t") == F.col("drop_t")), "left")
    kept = common.let(
        _lines(F.col("text")),
        lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone")), lambda i: ls[i]), "\n"),
    )
    return rows.select(
        "row",
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op2: lines of all documents, before and after, and the digest of what is kept."""
    found = dedup_lines(common.table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
