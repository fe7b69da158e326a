"""What the corpus operators share: reading tables, shared storage, text keys and graph components."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import Scope, shared_path, shared_table

#: The six ASCII blanks, as a regular-expression class and as characters.
BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a file of a small table: at least so many where there are more tasks than work, and at most.
LEAST_FILE_ROWS = 50_000
FILE_ROWS = 1_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to shared storage and read it again: lineage ends here and lost executors cost nothing.

    ``rows``, where they are known (or a bound of them), make no more tasks and files than such a table is worth."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    if rows is not None:
        df = df.coalesce(max(1, min(spark.sparkContext.defaultParallelism, ceil(rows / LEAST_FILE_ROWS)), ceil(rows / FILE_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int, tag: str, partition_by: str | None = None) -> DataFrame:
    """``df`` as a table in shared storage, bucketed and sorted by ``keys``: joins on them with another table of as many
    buckets have no exchange. A frame that is dealt out so already stays as it is; else it is dealt out first, so that
    each bucket is one file. The table goes with the scope that it is made in."""
    path = shared_path(df.sparkSession, tag)
    writer = df.repartition(buckets, *keys).coalesce(buckets).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    name = shared_table(path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast path, on which ``lower`` does just that."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``: a lambda variable cannot be expanded a second time."""
    return F.transform(F.array(value), body)[0]


def row_key(*columns: Column) -> list[Column]:
    """128 bits that identify a row by the values of ``columns``; equal rows share them, nulls count as values."""
    parts = [x for c in columns for x in (c, c.isNull())]
    return [F.xxhash64(*parts).alias("row_a"), F.xxhash64(F.lit("row"), *parts).alias("row_b")]


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: (node, component), component being the smallest node of each.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until the edges no longer change, which takes a
    logarithmic number of rounds as a rule and always ends: each round that changes edges brings some end nearer to the
    smallest node. Every step is a keyed minimum and a join with it; the minima are stored, so that both sides of the join
    are plain shuffles and the partition of a group's hub can be split. Edges go to shared storage between rounds, so the
    plan stays short. Nodes without a link are not returned; loops and repeated links do no harm."""
    with Scope(links.sparkSession) as scope:
        edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        state, before = _state(edges), None
        while state != before:
            n = state[0]  # a step moves edges and merges some, but makes none
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", 2 * n)
            large = stored(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star", n)
            low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least", n)
            small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
            edges = stored(small, "links", n)
            scope.discard(keep=1)
            state, before = _state(edges), state
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def crc_sql(number: str) -> str:
    """Unsigned CRC-32 of a decimal number, in SQL: byte by byte, bit by bit."""
    shift = "lambda d, k: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384::BIGINT) ELSE d // 2 END"
    byte = f"lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), {shift})"
    codes = f"list_transform(string_split({number}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), {byte}), 4294967295::BIGINT)"


def changes(columns: list[pa.Array]) -> np.ndarray:
    """For each row but the first, whether it differs from the one before in some column; null equals null."""
    new = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        a, b = c[1:], c[:-1]
        new |= (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)) | pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return new


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """One table for each run of neighbouring rows that agree in their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and changes([pa.concat_arrays([held[-1].column(i)[-1:], b.column(i)[:1]]) for i in range(keys)])[0]:
            yield pa.Table.from_batches(held)
            held = []
        starts = [0, *(np.flatnonzero(changes([b.column(i) for i in range(keys)])) + 1).tolist(), b.num_rows]
        for start, end in zip(starts, starts[1:], strict=False):
            held.append(b.slice(start, end - start))
            if end < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def numbered(df: DataFrame, group: str, order: list[str], tag: str, name: str = "pos") -> DataFrame:
    """``df``, stored, with the place of each row within its ``group`` by ``order`` (nulls first), counted from 0.

    Rows are sorted by ranges of (group, order), so that a group of any size, and rows that tie, spread over tasks. A task
    numbers its rows group by group; only the first group of a task can go on from an earlier one, so one row for each
    task says how far it had come."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys, "_tie").drop("_tie")
    columns, at = df.columns, df.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, before, head, last = TaskContext.get().partitionId(), 0, 0, True, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.r_[last is not None and bool(changes([pa.concat_arrays([last, b.column(at)[:1]])])[0]), changes([b.column(at)])]
            place = np.arange(n)
            starts = np.maximum.accumulate(np.where(new, place, -1))
            number = np.where(starts < 0, place + before, place - starts)
            heads = (starts < 0) & head
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number), pa.array(np.full(n, task)), pa.array(place + seen), pa.array(heads)], [*columns, name, "_task", "_row", "_head"])
            seen, before, head, last = seen + n, int(number[-1]) + 1, bool(heads[-1]), b.column(at)[-1:]

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType()), T.StructField("_task", T.LongType()), T.StructField("_row", T.LongType()), T.StructField("_head", T.BooleanType())])
    rows = stored(dealt.mapInArrow(run, schema), tag)
    ends = rows.groupBy("_task").agg(F.min_by(F.struct(group), "_row").alias("first"), F.max_by(F.struct(group), "_row").alias("last"), F.max_by(name, "_row").alias("n"))
    carried, tail, last = [], 0, None
    for r in ends.orderBy("_task").collect():  # one row for each task
        carry = tail if last is not None and r["first"] == last else 0
        tail = r["n"] + 1 + (carry if r["first"] == r["last"] else 0)
        last = r["last"]
        if carry:
            carried.append((r["_task"], carry))
    if carried:
        more = df.sparkSession.createDataFrame(carried, "_task bigint, _carry bigint")
        rows = rows.join(F.broadcast(more), "_task", "left").withColumn(name, F.col(name) + F.when(F.col("_head"), F.coalesce("_carry", F.lit(0))).otherwise(0))
    return rows.select(*columns, name)
