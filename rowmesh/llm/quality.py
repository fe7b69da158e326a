"""Quality rules: counts within each text, and line frequency across the documents of a host.

The counts are one narrow pass of column expressions. For line frequency, normalised lines are hashed, distinct
documents (by text, so that exact copies count once) are counted for each host and line, and lines above the limit are
removed from all documents of the host but the largest id that holds them, so that no text leaves the corpus
altogether. A document of which too little remains is depleted and rejected: less than a share of its words, or fewer words
than the base rule asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is removed if more distinct documents of its host hold it than this number and this share of the host's.
LINE_DOCS = 20
LINE_SHARE = 0.02
#: Rejected is what keeps less than this share of its words.
LEAST_KEPT = 0.3


def words_of(text: Column) -> Column:
    """Runs of other characters than the six ASCII blanks."""
    trimmed = F.btrim(text, F.lit(common.BLANKS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, common.BLANK + "+"))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    To find three-word windows that occur twice, each window's hash is packed with its position into one integer, high
    bits first; in sorted order equal windows are neighbours. Positions take as few bits as the text needs. What the
    hashes leave is sorted once more by its words, so that only equal windows count."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(common.BLANKS)) != "")
    df = docs.withColumn("q_words", words_of(F.col(text_col))).withColumn("q_lines", lines)
    df = df.withColumn("n_words", F.size("q_words").cast("long")).withColumn("q_hash", F.transform("q_words", lambda x: F.xxhash64(x)))
    df = df.withColumn("q_bits", F.length(F.bin("n_words")))
    after = lambda k: F.slice("q_hash", F.lit(k + 1), F.size("q_hash"))
    windows = F.zip_with(F.zip_with("q_hash", after(1), lambda x, y: F.xxhash64(x, y)), after(2), lambda x, y: F.xxhash64(x, y))
    windows = F.slice(windows, F.lit(1), F.size("q_hash") - 2)  # beyond there is no third word
    packed = F.transform(windows, lambda x, i: F.call_function("shiftleft", x, F.col("q_bits")).bitwiseOR(i.cast("long")))
    df = df.withColumn("q_packed", F.when(F.col("n_words") >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    equal = lambda x, y: F.call_function("shiftrightunsigned", x.bitwiseXOR(y), F.col("q_bits")) == 0
    again = F.zip_with("q_packed", F.slice("q_packed", F.lit(2), F.size("q_packed")), lambda x, y: F.when(equal(x, y), F.array(x, y)))
    again = F.array_distinct(F.flatten(F.array_compact(again)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("q_bits")) - 1
    word = lambda i, j: F.get("q_words", i.cast("int") + j)
    df = df.withColumn("q_same", F.sort_array(F.transform(F.transform(again, lambda x: x.bitwiseAND(mask)), lambda i: F.struct(word(i, 0).alias("a"), word(i, 1).alias("b"), word(i, 2).alias("c"), i.alias("i")))))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    exact = F.filter("q_same", lambda x, j: F.coalesce(same(x, F.get("q_same", j - 1)), F.lit(False)) | F.coalesce(same(x, F.get("q_same", j + 1)), F.lit(False)))
    df = df.withColumn("q_at", F.sort_array(F.transform(exact, lambda x: x["i"])))
    covered = F.transform("q_at", lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get("q_at", j + 1) - x, F.lit(3).cast("long"))))
    return df.select(
        *(docs[c] for c in docs.columns),
        "n_words",
        F.char_length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
    )


def line_losses(docs: DataFrame, id_col: str, text_col: str, host_col: str, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(id, t, lost, gone): words that each document loses to lines above its host's limit, and the places of those lines,
    counted from 0; none lost, no row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    lines = rows.select("id", "host", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("id", "host", "t", "pos", F.btrim("line", F.lit(common.BLANKS)).alias("line")).where("line <> ''")
    key = common.ascii_lower(F.col("line"))
    lines = lines.select("id", "host", "t", "pos", F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"), F.size(F.split("line", common.BLANK + "+")).alias("words"))
    lines = common.stored(lines, "quality-lines")
    held = lines.groupBy("host", "a", "b", "t").agg(F.max("id").alias("last")).groupBy("host", "a", "b").agg(F.count("*").alias("n"), F.max("last").alias("last"))
    hosts = rows.select("host", "t").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    common_lines = held.where(F.col("n") > line_docs).join(hosts, "host").where(F.col("n") > line_share * F.col("docs")).select("host", "a", "b", "last")
    common_lines = common.stored(common_lines, "common-lines")  # so that the partition of a very common line can be split
    lost = lines.join(common_lines, ["host", "a", "b"]).where(~F.col("id").eqNullSafe(F.col("last")))
    return lost.groupBy("id", "t").agg(F.sum("words").alias("lost"), F.collect_set("pos").alias("gone"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_kept: float = LEAST_KEPT, carry_text: bool = False) -> DataFrame:
    """Each row of ``docs`` as (row, the counts, words_lost, lines_lost, base_failed, kept); row is a struct of its columns and
    lines_lost an array of the places of the lines that the host's limit removes, counted from 0.

    With ``carry_text`` row holds the text, and cleaned is the text without the lines that it loses; without it there is
    neither, so that plain verdicts never shuffle texts. Null and empty texts have
    no words and fail the base rules. Null and empty hosts are one host. Rows that repeat an id are judged each by
    its own text. An empty table gives an empty result."""
    carried = [c for c in docs.columns if carry_text or c != text_col]
    rows = docs.select(F.struct(*(docs[c] for c in carried)).alias("row"), F.col(id_col).alias("q_id"), F.col(text_col).alias("q_text"))
    counted = with_counts(rows, "q_text").select("row", "q_id", F.xxhash64("q_text").alias("q_t"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    losses = line_losses(docs, id_col, text_col, host_col).hint("shuffle_hash")
    joined = counted.join(losses, F.col("q_id").eqNullSafe(F.col("id")) & (F.col("q_t") == F.col("t")), "left").withColumn("words_lost", F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("words_lost")
    enough = (left >= least_kept * F.col("n_words")) & (left >= MIN_WORDS)
    # one comparison instead of a conjunction: a filter on it stays above the join, where the counts are made already
    kept = F.least((~failed).cast("int"), enough.cast("int")) == 1
    found = joined.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_lost", F.coalesce(F.sort_array("gone"), F.array().cast("array<int>")).alias("lines_lost"), failed.alias("base_failed"), kept.alias("kept"))
    text = lambda: F.col("row")[text_col]
    return found.withColumn("cleaned", F.when(F.size("lines_lost") == 0, text()).otherwise(without(text(), F.col("lines_lost")))) if carry_text else found


def without(text: Column, gone: Column) -> Column:
    """``text`` without the lines at the places ``gone``."""
    return common.let(F.split(text, "\n"), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: ls[i]), "\n"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: counts and verdict of every document, and which lines its host's limit removes."""
    found = judge(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_lost", F.sha2(F.array_join("lines_lost", ",").cast("binary"), 256).alias("lines_lost_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, raw, line, pos,
             translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
      FROM (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
            FROM (SELECT doc_id, host, text, unnest(ls) AS raw, unnest(range(len(ls))) AS pos FROM d)) WHERE line <> ''),
u AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM l GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
often AS (SELECT host, key, max(doc_id) AS last FROM l JOIN hosts USING (host) GROUP BY host, key, docs
          HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > 0.02::DOUBLE * docs),
lost AS (SELECT doc_id, sum(words) AS lost, string_agg(pos, ',' ORDER BY pos) AS places FROM l JOIN often USING (host, key) WHERE doc_id <> last GROUP BY doc_id),
b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(lost, 0)::BIGINT AS lost, sha256(coalesce(places, '')) AS lines_lost_sha256
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - lost >= 0.3::DOUBLE * n_words AND n_words - lost >= 50 AS kept, lost AS words_lost, lines_lost_sha256
FROM f
"""
