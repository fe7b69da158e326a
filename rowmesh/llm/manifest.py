"""A Merkle manifest of a dataset, built and proved by time-forward processing.

Nodes are labelled (level, index) within a block of ``FANOUT ** BLOCK_LEVELS`` neighbouring leaves, and a priority queue
ordered by label delivers the digests of children to their parent. The nodes at the top of the blocks are the leaves of the
next stage, until each group has one node, its subroot; the subroots are the leaves of one more tree. Then the sweep is
reversed, stage by stage: a node receives its proof from its label's end of the tree, the suffix that leads from it to the
root, and sends each child that suffix behind the child's own siblings, until the leaves have theirs.

A block is bounded, whatever a group holds, and blocks of one group lie in different tasks. Places within groups come from a
sort by ranges. Only digests and proofs move; texts are hashed where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .timeforward import SpillingQueue

FANOUT = 3
BLOCK_LEVELS = 8
PROOF = "array<struct<place:int,siblings:array<string>>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Label = tuple[int, int]


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def climb(leaves: list[str], levels: int, fanout: int = FANOUT) -> tuple[str, list[tuple[Label, list[tuple[int, str]]]]]:
    """The digest ``levels`` above ``leaves``, and each inner node's label with the (index, digest) of its children, in
    the order in which they were visited."""
    queue, visited, top = SpillingQueue(), [], leaves[0]
    for i, leaf in enumerate(leaves if levels else []):
        queue.push((1, i // fanout), (i, leaf))
    while (label := queue.label()) is not None:
        children = queue.pop(label)
        top = digest([d for _, d in children])
        visited.append((label, children))
        if label[0] < levels:
            queue.push((label[0] + 1, label[1] // fanout), (label[1], top))
    return top, visited


def descend(n: int, visited: list[tuple[Label, list[tuple[int, str]]]], suffix: list) -> list[list]:
    """The proof of each of ``n`` leaves: its siblings on every level up to the top, then the top's own ``suffix``."""
    if not visited:
        return [suffix]
    queue, proofs = SpillingQueue(), [suffix] * n
    queue.push((-visited[-1][0][0], -visited[-1][0][1]), suffix)
    for (level, index), children in reversed(visited):
        above = queue.pop((-level, -index))[0]
        for place, (i, _) in enumerate(children):
            proof = [{"place": place, "siblings": [d for j, d in children if j != i]}, *above]
            if level == 1:
                proofs[i] = proof
            else:
                queue.push((-(level - 1), -i), proof)
    return proofs


def _tops(fanout: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.runs(batches, 2):
            leaves = block.column("digest").to_pylist()
            own = height(len(leaves), fanout)
            alone, _ = climb(leaves, own, fanout)
            lifted = alone
            for _ in range(levels - own):
                lifted = digest([lifted])
            yield pa.RecordBatch.from_pydict({"grp": block.column("grp")[:1].combine_chunks(), "block": block.column("block")[:1].combine_chunks(), "alone": [alone], "lifted": [lifted]})

    return run


class Forest:
    """A tree over each group of ``leaves(grp, pos, digest, ...)``, places being 0, 1, 2 ... within each ``grp``."""

    def __init__(self, leaves: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS):
        self.fanout, self.levels, self.stages = fanout, block_levels, []
        self.roots: DataFrame | None = None
        size = fanout**block_levels
        while True:
            leaves = leaves.withColumn("block", F.floor(F.col("pos") / size))
            self.stages.append(leaves)
            dealt = leaves.select("grp", "block", "pos", "digest").repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
            tops = common.stored(dealt.mapInArrow(_tops(fanout, block_levels), "grp string, block bigint, alone string, lifted string"), "block-tops")
            last = tops.groupBy("grp").agg(F.max("block").alias("last"), F.min_by("alone", "block").alias("digest"))
            done = last.where("last = 0").select("grp", "digest", F.lit(len(self.stages) - 1).alias("stage"))
            self.roots = done if self.roots is None else self.roots.union(done)
            more = last.where("last > 0").select("grp")
            if more.isEmpty():
                break
            leaves = common.stored(tops.join(more, "grp").select("grp", F.col("block").alias("pos"), F.col("lifted").alias("digest")), "stage-leaves")
        self.roots = common.stored(self.roots, "roots")

    def proofs(self, suffixes: DataFrame) -> DataFrame:
        """Each leaf with its columns, proof and top, from ``suffixes(grp, proof, top)``: what leads on from each group's
        root, and a struct that is handed to its leaves as it is."""
        top = suffixes.schema["top"].dataType
        ended = suffixes.join(self.roots.select("grp", "stage"), "grp")
        sent = None
        for stage in range(len(self.stages) - 1, -1, -1):
            own = ended.where(F.col("stage") == stage).select("grp", F.lit(0).cast("long").alias("block"), F.lit(False).alias("lifted"), "proof", "top")
            messages = own if sent is None else own.union(sent)
            sent = self._stage(self.stages[stage], messages, top)
            if stage:
                sent = sent.select("grp", F.col("pos").alias("block"), F.lit(True).alias("lifted"), "proof", "top")
        return sent

    def _stage(self, leaves: DataFrame, messages: DataFrame, top: T.DataType) -> DataFrame:
        fanout, levels, kept = self.fanout, self.levels, [c for c in leaves.columns if c not in ("grp", "block")]
        message = [F.col(c) for c in ("lifted", "proof", "top")]
        none = [F.lit(None).cast(messages.schema[c].dataType).alias(c) for c in ("lifted", "proof", "top")]
        both = leaves.select("grp", "block", *kept, *none).union(messages.select("grp", "block", *(F.lit(None).cast(leaves.schema[c].dataType).alias(c) for c in kept), *message))
        both = both.repartition("grp", "block").sortWithinPartitions("grp", "block", F.col("pos").asc_nulls_first())
        schema = T.StructType([leaves.schema["grp"], *(leaves.schema[c] for c in kept), messages.schema["proof"], messages.schema["top"]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in common.runs(batches, 2):
                sent, rows = block.slice(0, 1).to_pylist()[0], block.slice(1).combine_chunks()
                digests = rows.column("digest").to_pylist()
                _, visited = climb(digests, levels if sent["lifted"] else height(len(digests), fanout), fanout)
                proofs = descend(len(digests), visited, sent["proof"])
                columns = [rows.column(c).chunk(0) if rows.num_rows else pa.array([], block.schema.field(c).type) for c in ("grp", *kept)]
                columns += [pa.array(proofs, block.schema.field("proof").type), pa.array([sent["top"]] * len(digests), block.schema.field("top").type)]
                yield pa.RecordBatch.from_arrays(columns, ["grp", *kept, "proof", "top"])

        return both.mapInArrow(run, schema)


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def siblings_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, level by level."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda p: p["siblings"])), "").cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    join = lambda p, start, n: F.array_join(F.slice(p["siblings"], start, n), "")
    step = lambda d, p: F.sha2(F.concat(join(p, F.lit(1), p["place"]), d, join(p, p["place"] + 1, F.size(p["siblings"]))).cast("binary"), 256)
    return F.aggregate(proof, leaf, step)


def manifest(docs: DataFrame, columns: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", also: dict[str, Column] | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(id, grp, pos, leaf, subroot, root, proof) of each row, and what ``also`` computes from the row.

    A leaf is the SHA-256 of the row's ``columns``, each as ``-`` or byte count, colon and value. Leaves of a group ascend
    by id, null first; of equal ids by digest, and equal rows are leaves of their own. Groups ascend by their bytes, null
    first (grp is empty then, and starts with ``=`` otherwise). proof lists, for each level up to the root, the leaf's
    place in its run and the digests of the run's others. An empty table gives an empty result; further columns do no
    harm."""
    also = also or {}
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("grp"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"),
        *(c.alias(name) for name, c in also.items()),
    )
    forest = Forest(common.numbered(rows, "grp", ["id", "digest"], "leaves"), fanout, block_levels)
    heads = forest.roots.select(F.lit("").alias("grp"), F.col("grp").alias("source_grp"), "digest")
    crown = Forest(common.numbered(heads, "grp", ["source_grp"], "subroots"), fanout, block_levels)
    root = crown.roots.select("grp", F.array().cast(PROOF).alias("proof"), F.struct(F.col("digest").alias("root")).alias("top"))
    lower = crown.proofs(root).select(F.col("source_grp").alias("grp"), "proof", F.struct(F.col("digest").alias("subroot"), F.col("top.root").alias("root")).alias("top"))
    found = forest.proofs(common.stored(lower, "subroot-proofs"))
    return found.select("id", "grp", "pos", F.col("digest").alias("leaf"), "top.subroot", "top.root", "proof", *also)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: leaf, subroot, root and proof of every document, and what a tampered document's leaf folds to."""
    docs = common.table(spark, sf_dir, "documents")
    cut = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(cut, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = leaf_digest([changed if c == "text" else F.col(c) for c in FIELDS])
    found = manifest(docs, also={"tampered": tampered})
    found = found.withColumn("folded_root", folded(F.col("tampered"), F.col("proof")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(c: str, value: str | None = None) -> str:
    value = value or f"{c}::VARCHAR"
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join([*(_field_sql(c) for c in FIELDS[:-1]), _field_sql('text', text)])})"


SQL = f"""
WITH RECURSIVE
d AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
             CASE WHEN {common.crc_sql("doc_id")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS tampered FROM documents),
low AS (
  SELECT source, 0 AS lvl, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM d
  UNION ALL
  SELECT source, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY source, lvl, i // 3, n),
high AS (
  SELECT source, 0 AS lvl, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM low WHERE n = 1
  UNION ALL
  SELECT NULL, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY lvl, i // 3, n),
node AS (SELECT false AS crown, source, lvl, i, h FROM low UNION ALL SELECT true, NULL, lvl, i, h FROM high),
root AS (SELECT h AS root FROM high WHERE n = 1),
place AS (SELECT doc_id, source, leaf, tampered, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
spot AS (SELECT coalesce(source, '') AS s, source IS NULL AS none, i AS j, h AS subroot FROM high WHERE lvl = 0),
path AS (
  SELECT p.*, subroot, j, (SELECT max(lvl) FROM low WHERE low.source IS NOT DISTINCT FROM p.source) AS levels, (SELECT max(lvl) FROM high) AS more
  FROM place p JOIN spot ON coalesce(p.source, '') = s AND (p.source IS NULL) = none),
fold AS (
  SELECT doc_id, source, leaf, subroot, i, j, levels, more, 0 AS step, tampered AS h, '' AS proof FROM path
  UNION ALL
  SELECT doc_id, source, leaf, subroot, CASE WHEN step < levels THEN i // 3 ELSE i END, CASE WHEN step < levels THEN j ELSE j // 3 END, levels, more, step + 1,
    sha256(before || h || after), proof || before || after
  FROM (
    SELECT f.doc_id, f.source, f.leaf, f.subroot, f.i, f.j, f.levels, f.more, f.step, f.h, f.proof,
      coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (WHERE o.i < CASE WHEN f.step < f.levels THEN f.i ELSE f.j END), '') AS before,
      coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (WHERE o.i > CASE WHEN f.step < f.levels THEN f.i ELSE f.j END), '') AS after
    FROM fold f LEFT JOIN node o ON o.crown = (f.step >= f.levels) AND (o.crown OR o.source IS NOT DISTINCT FROM f.source)
      AND o.lvl = CASE WHEN f.step < f.levels THEN f.step ELSE f.step - f.levels END AND o.i // 3 = CASE WHEN f.step < f.levels THEN f.i ELSE f.j END // 3
    WHERE f.step < f.levels + f.more GROUP BY ALL))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM fold, root WHERE step = levels + more
"""
