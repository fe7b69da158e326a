"""The prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of the first d turns; its key is a 128-bit hash of that sequence, the exclusive or of hashes
of (place, turn), so that keys are prefix scans and a long conversation is scanned in blocks. Members, weights and ends of
all nodes come from one aggregate. Subtree totals then pass from children to parents: the trie is cut into shards, in each
of which Spark sorts the nodes in reverse level order and a spilling priority queue carries each node's totals to its
parent, further down the sort; afterwards the same is done across the roots of the shards.

Cuts are made at *heavy* nodes, those with more than a shard's worth of turns below, and at every ``band`` levels. Heavy
nodes lie above all others, so what remains below them are subtrees of bounded weight; how heavy a node must be, and how
wide a band is, grows with the corpus, so that at most ``HEAVY`` heavy nodes and about ``UPPER`` shards with shards below
them meet in the one task that works across shards. Where no conversation is longer than a band, no shard has shards
below, and the totals of a shard's nodes are final at once; else those shards are gone through again with what came from
below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .timeforward import SpillingQueue

#: Turns below a node that one shard takes at least, and bounds of what meets across shards.
SHARD_TURNS = 50_000
HEAVY = 100_000
BAND = 4096
UPPER = 1_000_000
#: Turns of one conversation that are scanned together.
SCAN = 4096
#: Ids that are joined to one piece of text before a node's list of ends is hashed.
CHUNK = 4096
#: The query's rule: the most turns that a conversation takes over, and how many conversations share an origin.
MOST_TAKEN = 8
ORIGIN = 5

KEY = ["depth", "a", "b"]
SHARD = ["td", "ta", "tb"]
PARENT = ["pd", "pa", "pb"]


def numbered_turns(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, x, y, bytes) of each row: its place in the conversation by turn, a 128-bit hash of role and text, and the
    text's length. Null role or text is empty, null turns come first, turns of one number go by their hashes, and rows
    without a conversation are no turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = convs.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit("turn"), role, text).alias("y"), F.octet_length(text).cast("long").alias("bytes")
    )
    return common.numbered(rows, "conv", ["turn", "x", "y"], "turns").select("conv", "pos", "x", "y", "bytes")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv").agg(F.count("*").alias("n"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's conversations: (conv, depth, x, y, bytes, size) of each rebuilt turn and (conv, size) of each
    conversation. Conversation c starts with the first h turns of c - c % 5 (all if fewer, none if there is no such one), h
    being the CRC-32 of its number modulo 9, and goes on with its own after the first h."""
    sizes = common.stored(lengths(turns), "lengths")
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_TAKEN + 1)).alias("h")
    origin = (F.col("conv") - F.col("conv") % ORIGIN).alias("origin")
    facts = sizes.select("conv", "n", taken, origin).join(sizes.select(F.col("conv").alias("origin"), F.col("n").alias("theirs")), "origin", "left")
    facts = facts.withColumn("take", F.least("h", F.coalesce("theirs", F.lit(0)).cast("long")))
    facts = common.stored(facts.select("conv", "origin", "h", "take", (F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "rebuilt-lengths")
    own = turns.join(facts, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("take") + 1).alias("depth"), "x", "y", "bytes", "size")
    near = F.explode(F.sequence(F.lit(1 - ORIGIN), F.lit(ORIGIN - 1))).alias("k")
    lent = turns.where((F.col("pos") < MOST_TAKEN) & (F.col("conv") % ORIGIN == 0)).select(F.col("conv").alias("lender"), near, "pos", "x", "y", "bytes")
    lent = lent.withColumn("conv", F.try_add(F.col("lender"), F.col("k"))).join(facts, "conv").where("origin = lender and pos < take")
    return own.union(lent.select("conv", (F.col("pos") + 1).alias("depth"), "x", "y", "bytes", "size")), facts.select("conv", "size")


def prefix_keys(turns: DataFrame, scan: int = SCAN) -> DataFrame:
    """(conv, depth, a, b, pa, pb, bytes, size): the keys of each turn's node and of the node's parent."""
    rows = turns.select("*", F.floor((F.col("depth") - 1) / scan).alias("block"), F.xxhash64("depth", "x", "y").alias("u"), F.xxhash64(F.lit("prefix"), "depth", "x", "y").alias("v"))
    upto = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    long = rows.where(F.col("size") > scan).groupBy("conv", "block").agg(F.bit_xor("u").alias("u"), F.bit_xor("v").alias("v"))
    carried = long.select("conv", "block", F.bit_xor("u").over(before).alias("cu"), F.bit_xor("v").over(before).alias("cv")).where("block > 0")
    keyed = rows.withColumns({"a": F.bit_xor("u").over(upto), "b": F.bit_xor("v").over(upto)}).join(carried, ["conv", "block"], "left")
    a, b = (F.col(k).bitwiseXOR(F.coalesce(c, F.lit(0).cast("long"))) for k, c in (("a", "cu"), ("b", "cv")))
    return keyed.select("conv", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("u")).alias("pa"), b.bitwiseXOR(F.col("v")).alias("pb"), "bytes", "size")


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and messages, shard by shard in reverse level order: each node takes what was sent to it, and sends its own
    totals to its parent unless it is the shard's top. Messages from outside stand before the node that they are for."""
    queue, shard = SpillingQueue(), None
    for batch in batches:
        column = {c: batch.column(c).to_pylist() for c in (*SHARD, *KEY, *PARENT, "leaves", "tokens", "children", "is_node")}
        totals = []
        for td, ta, tb, depth, a, b, pd, pa_, pb, leaves, tokens, children, is_node in zip(*column.values(), strict=True):
            if shard != (td, ta, tb):
                if len(queue):
                    raise ValueError(f"a message to a node that is not in the shard {shard}")
                shard = (td, ta, tb)
            label = (-depth, a, b)
            if not is_node:
                queue.push(label, (leaves, tokens, children))
                continue
            for got in queue.pop(label):
                leaves, tokens, children = leaves + got[0], tokens + got[1], children + got[2]
            totals.append((leaves, tokens, children))
            if shard != (depth, a, b):
                queue.push((-pd, pa_, pb), (leaves, tokens, 1))
        nodes = batch.filter(batch.column("is_node"))
        found = np.array(totals, np.int64).reshape(-1, 3)
        fresh = dict(zip(("leaves", "tokens", "children"), found.T, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(fresh[c]) if c in fresh else nodes.column(c) for c in batch.schema.names], schema=batch.schema)
    if len(queue):
        raise ValueError(f"a message to a node that is not in the shard {shard}")


def settled(nodes: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """``nodes`` with their totals within their shard and from ``messages(td, ta, tb, depth, a, b, leaves, tokens,
    children)``, which are summed by receiver first. leaves, tokens and children come in as a node's own."""
    rows = nodes.withColumn("is_node", F.lit(True))
    if messages is not None:
        sums = messages.groupBy(*SHARD, *KEY).agg(*(F.sum(c).alias(c) for c in ("leaves", "tokens", "children")))
        rows = rows.unionByName(sums.withColumn("is_node", F.lit(False)), allowMissingColumns=True)
    rows = rows.repartition(*SHARD).sortWithinPartitions(*SHARD, F.desc("depth"), "a", "b", "is_node")
    return rows.mapInArrow(_forward, rows.schema).drop("is_node")


@dataclass(frozen=True)
class Trie:
    """``nodes`` (depth, a, b, conv, parent_conv, n_convs, n_ends, end_conv, leaves, tokens, children), one row for each,
    and ``ends`` (conv, depth, a, b), the node at which each conversation ends."""

    nodes: DataFrame
    ends: DataFrame


def prefix_trie(turns: DataFrame, convs: DataFrame, shard_turns: int = SHARD_TURNS, heavy: int = HEAVY, band: int = BAND, scan: int = SCAN) -> Trie:
    """The trie of ``turns(conv, depth, x, y, bytes, size)``, depths being 1 to size, and ``convs(conv, size)``, which also
    has conversations without turns.

    conv is the smallest member of a node, n_convs the number of members, n_ends of those that end there and end_conv the
    smallest of these. leaves, tokens and children are the childless nodes below or at the node, the sum below and at it of
    (n_convs - 1) * bytes, and the nodes one step below. Equal conversations are members of the same nodes. Without
    conversations there are no nodes, not even a root; a conversation without turns is a member of the root alone."""
    rows = common.stored(prefix_keys(turns, scan), "prefix-keys")
    band = max(band, ceil(rows.count() / UPPER))
    at = F.floor((F.col("depth") - 1) / band)
    rest = F.least(F.col("size"), (at + 1) * band) - F.col("depth") + 1
    last = F.col("depth") == F.col("size")
    zero = F.lit(0).cast("long")
    nodes = rows.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.min("bytes").alias("bytes"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.sum(rest).alias("weight"), F.count_if(last).alias("n_ends"), F.min(F.when(last, F.col("conv"))).alias("end_conv"),
    )
    none = F.col("size") == 0
    root = convs.agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv"), zero.alias("bytes"), zero.alias("pa"), zero.alias("pb"),
        zero.alias("weight"), F.count_if(none).alias("n_ends"), F.min(F.when(none, F.col("conv"))).alias("end_conv"),
    )
    root = root.where("n_convs > 0").select(*(zero.alias(c) for c in KEY), "*")
    nodes = common.stored(nodes.unionByName(root), "trie-nodes")
    facts = nodes.agg(F.sum("weight").alias("weight"), F.max("depth").alias("deepest")).first()
    most, deep = max(shard_turns, ceil((facts["weight"] or 0) / heavy)), (facts["deepest"] or 0) > band
    own = {"leaves": (F.col("n_ends") == F.col("n_convs")).cast("long"), "tokens": (F.col("n_convs") - 1) * F.col("bytes"), "children": zero, "pd": F.col("depth") - 1}
    nodes = nodes.withColumns(own).withColumn("heavy", (F.col("weight") > most) | (F.col("depth") == 0))
    thick, thin = nodes.where("heavy"), nodes.where("not heavy")
    # the top of a conversation's part of a band is its first node there that is not heavy; no more than ``heavy`` are
    light = rows.join(F.broadcast(thick.select(*KEY)), KEY, "left_anti").groupBy("conv", at.alias("band")).agg(F.min_by(F.struct(*KEY), "depth").alias("top"))
    light = light.select("conv", "band", *(F.col("top")[k].alias(t) for k, t in zip(KEY, SHARD, strict=True)))
    shards = settled(thin.withColumn("band", at).join(light, ["conv", "band"]).drop("band"))
    shards = common.stored(shards, "shard-totals")
    is_top = reduce(lambda x, y: x & y, (F.col(k) == F.col(t) for k, t in zip(KEY, SHARD, strict=True)))
    tops = shards.where(is_top).drop(*SHARD)
    whole = [F.lit(0).cast("long").alias(t) for t in SHARD]
    if not deep:  # what is above a top is heavy
        above = settled(thick.select("*", *whole), tops.select(*whole, *(F.col(p).alias(k) for k, p in zip(KEY, PARENT, strict=True)), "leaves", "tokens", F.lit(1).cast("long").alias("children")))
        found = above.drop(*SHARD).unionByName(shards.drop(*SHARD))
    else:
        found = _across(thick, shards, tops, band, whole)
    found = common.stored(found.drop("heavy", "weight", "bytes"), "trie-totals")
    parents = found.select(*(F.col(k).alias(p) for k, p in zip(KEY, PARENT, strict=True)), F.col("conv").alias("parent_conv"))
    found = found.join(parents, PARENT, "left").drop(*PARENT)
    ends = rows.where(last).select("conv", *KEY).union(convs.where(none).select("conv", *(zero.alias(k) for k in KEY)))
    return Trie(found, ends)


def _across(thick: DataFrame, shards: DataFrame, tops: DataFrame, band: int, whole: list) -> DataFrame:
    """The totals of all nodes where shards have shards below them."""
    one = F.lit(1).cast("long").alias("children")
    cut = (F.col("pd") > 0) & (F.col("pd") % band == 0)
    units = tops.unionByName(thick)
    homes = shards.where(F.col("depth") % band == 0).select(*(F.col(k).alias(p) for k, p in zip(KEY, PARENT, strict=True)), *SHARD)
    # a unit hangs on a heavy node, or on the shard that holds its parent
    hung = units.where(cut).join(homes, PARENT, "left").unionByName(units.where(~cut), allowMissingColumns=True)
    up = [F.coalesce(t, p).alias(f"u{p}") for t, p in zip(SHARD, PARENT, strict=True)]
    hung = common.stored(hung.select("*", *up), "units")
    inner = hung.where("td is not null").select(*(F.col(t).alias(k) for k, t in zip(KEY, SHARD, strict=True))).distinct()
    inner = common.stored(inner, "inner-shards")
    upper = hung.join(inner.withColumn("inner", F.lit(True)), KEY, "left").withColumn("upper", F.col("heavy") | F.coalesce("inner", F.lit(False)))
    upper = common.stored(upper.drop("inner"), "upper-units")
    sent = upper.where("not upper").select(*whole, *(F.col(f"u{p}").alias(k) for k, p in zip(KEY, PARENT, strict=True)), "leaves", "tokens", one)
    lifted = upper.where("upper").drop(*SHARD).select("*", *whole).withColumns({f"o{p}": F.col(p) for p in PARENT}).withColumns({p: F.col(f"u{p}") for p in PARENT})
    above = settled(lifted.drop("upper"), sent).withColumns({p: F.col(f"o{p}") for p in PARENT})
    above = common.stored(above, "upper-totals")
    # once more through the shards with others below, now with the totals of those
    below = above.select(*KEY, *PARENT, *(F.col(f"u{p}") for p in PARENT), "leaves", "tokens").union(upper.where("not upper").select(*KEY, *PARENT, *(F.col(f"u{p}") for p in PARENT), "leaves", "tokens"))
    below = below.join(inner.select(*(F.col(k).alias(f"u{p}") for k, p in zip(KEY, PARENT, strict=True))), [f"u{p}" for p in PARENT])
    below = below.select(*(F.col(f"u{p}").alias(t) for t, p in zip(SHARD, PARENT, strict=True)), *(F.col(p).alias(k) for k, p in zip(KEY, PARENT, strict=True)), "leaves", "tokens", one)
    at_top = inner.select(*(F.col(k).alias(t) for k, t in zip(KEY, SHARD, strict=True)))
    first = shards.join(at_top, SHARD, "left_semi").withColumns({"leaves": (F.col("n_ends") == F.col("n_convs")).cast("long"), "tokens": (F.col("n_convs") - 1) * F.col("bytes"), "children": F.lit(0).cast("long")})
    again = settled(first, below)
    settled_at_once = shards.join(at_top, SHARD, "left_anti")
    columns = thick.columns
    return above.where("heavy").select(*columns).unionByName(again.select(*columns)).unionByName(settled_at_once.select(*columns))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in common.runs(batches, 3):
        ids = run.column("conv").to_pylist()
        for i in range(0, len(ids), CHUNK):
            part = ids[i : i + CHUNK]
            yield pa.RecordBatch.from_pydict({k: run.column(k)[:1].combine_chunks() for k in KEY} | {"first": pa.array(part[:1], pa.int64()), "ids": [",".join(map(str, part))]})


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    for batch in batches:
        found = []
        for *mine, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if mine != key:
                if key is not None:
                    found.append((*key, digest.hexdigest()))
                key, digest = mine, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _hashed(found)
    if key is not None:
        yield _hashed([(*key, digest.hexdigest())])


def _hashed(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*KEY, "sha"])


def ends_sha256(trie: Trie) -> DataFrame:
    """(depth, a, b, sha): the digest of the ids that end at each node with several, ascending and joined by commas.

    Ids are sorted by ranges and joined to pieces of text where they lie, so that a list of any length is hashed piece by
    piece, in bounded memory."""
    many = trie.nodes.where("n_ends > 1").select(*KEY)
    ends = trie.ends.join(many, KEY, "left_semi").select(*KEY, "conv")
    pieces = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(_chunks, "depth bigint, a bigint, b bigint, first bigint, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashes, "depth bigint, a bigint, b bigint, sha string")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the nodes of the trie of all rebuilt conversations."""
    trie = prefix_trie(*rebuilt(numbered_turns(common.table(spark, sf_dir, "conversations"))))
    few = F.sha2(F.coalesce(F.col("end_conv").cast("string"), F.lit("")).cast("binary"), 256)
    found = trie.nodes.join(ends_sha256(trie), KEY, "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"), F.coalesce("sha", few).alias("ends_sha256"),
    )


SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, {common.crc_sql("conv_id")} % {MOST_TAKEN + 1} AS h, conv_id - conv_id % {ORIGIN} AS origin FROM t GROUP BY conv_id),
f AS (SELECT c.*, least(c.h, coalesce(o.n, 0)) AS take FROM c LEFT JOIN c o ON c.origin = o.conv_id),
r AS (
  SELECT f.conv_id, pos + 1 AS d, role, text FROM f JOIN t ON t.conv_id = f.origin WHERE pos < take
  UNION ALL SELECT f.conv_id, pos - h + take + 1, role, text FROM f JOIN t ON t.conv_id = f.conv_id WHERE pos >= h),
p AS (
  SELECT conv_id, d, strlen(text) AS bytes, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS path, count(*) OVER (PARTITION BY conv_id) AS size FROM r
  UNION ALL SELECT conv_id, 0, 0, '', (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id) FROM c),
node AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved, count(*) FILTER (WHERE d = size) AS n_ends,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = size), '')) AS ends_sha256 FROM p GROUP BY d, path),
total AS (
  SELECT path, count(*) FILTER (WHERE n_ends = n_convs) AS n_leaves, sum(saved) AS saved_tokens, count(*) FILTER (WHERE lower = d - 1) AS n_children
  FROM (SELECT *, left(path, (64 * lower)::BIGINT) AS above FROM (SELECT *, unnest(range(d + 1)) AS lower FROM node)) AS x(d, path0, conv_id, n_convs, saved, n_ends, ends_sha256, lower, path) GROUP BY path)
SELECT n.conv_id, n.d::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN total USING (path) LEFT JOIN node o ON o.d = n.d - 1 AND o.path = left(n.path, (64 * (n.d - 1))::BIGINT)
"""
