import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rowmesh.llm import common, manifest, timeforward

SF = "/root/testdata/sf0.001"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
DOC = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """All levels, lowest first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    """(digests before, digests after) of the runs on the way up from leaf ``i``."""
    out = []
    for level in levels[:-1]:
        run = level[i - i % 3 : i - i % 3 + 3]
        out.append((run[: i % 3], run[i % 3 + 1 :]))
        i //= 3
    return out


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text); the query's rows in memory."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    crown = tree([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = path(trees[s], i) + path(crown, j)
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            at = leaf((*r[:4], r[4].replace("\n", ""))) if cut else own
            for before, after in steps:
                at = H(*before, at, *after)
            out.append((r[0], own, trees[s][-1][0], crown[-1][0], H(*(d for b, a in steps for d in b + a)), at, at == crown[-1][0]))
    return sorted(out, key=str)


def got(df, **how):
    cut = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(cut, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest.manifest(df, also={"tampered": manifest.leaf_digest([text if c == "text" else F.col(c) for c in manifest.FIELDS])}, **how)
    found = found.select("id", "leaf", "subroot", "root", manifest.siblings_digest(F.col("proof")), manifest.folded(F.col("tampered"), F.col("proof")).alias("f"), (F.col("f") == F.col("root")))
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    made = [(i, f"s{i % 4}", "en", i, f"text {i}\nmore") for i in range(60)]
    made += [(None, None, None, None, None), (None, None, "en", 3, "a\nb"), (7, None, None, 1, ""), (-5, "", "x", 0, "\n"), (-50, "", "x", 0, "y"), (9, "é", "ü", 2, "ß\n" * 9000), (9, "é", "ü", 2, "other"), (9, "z", "ü", 2, "alone")]
    made += [(80, "s1", "en", 5, "the same\nrow")] * 7
    return made


@pytest.mark.parametrize("levels", [1, 2, manifest.BLOCK_LEVELS])
def test_like_hashing_in_memory(spark, rows, levels):
    """Whatever the size of a block, and with as many stages as it takes."""
    assert got(spark.createDataFrame(rows, DOC), block_levels=levels) == plain(rows)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = manifest.query(spark, SF)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(docs)


def test_a_proof_shows_every_change(spark, rows):
    """A leaf with another value, and a leaf in another's place, do not lead to the root."""
    found = manifest.manifest(spark.createDataFrame(rows, DOC)).select("leaf", "root", "proof").collect()
    fold = spark.createDataFrame([(H("x"), found[0].proof), (found[1].leaf, found[0].proof), (found[0].leaf, found[0].proof)], f"leaf string, proof {manifest.PROOF}")
    assert [r[0] == found[0].root for r in fold.select(manifest.folded(F.col("leaf"), F.col("proof"))).collect()] == [False, False, True]


def test_clashing_columns_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, DOC)
    named = df.select("*", F.lit(1).alias("pos"), F.lit(2).alias("grp"), F.lit(3).alias("proof"), F.lit(4).alias("digest"), F.lit(5).alias("id"))
    assert got(named) == plain(rows)
    assert got(df.limit(0)) == []


def test_numbered_is_the_place_in_the_group(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *range(300)])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    found = common.numbered(df, "g", ["v"], "test").collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r.pos, (r.v is not None, r.v or 0)) for r in found if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
    assert sorted(((r.g, r.v) for r in found), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_queue_spills_and_keeps_the_order(most):
    rng, queue = random.Random(1), timeforward.SpillingQueue(most)
    waiting, sent = [], 0
    for step in range(600):
        for _ in range(rng.randrange(4)):
            label = (step // 3 + rng.randrange(5), rng.randrange(3))
            queue.push(label, sent)
            waiting.append((label, sent))
            sent += 1
        if waiting and rng.random() < 0.8:
            label = min(waiting)[0]
            assert queue.label() == label and queue.pop(label) == [v for k, v in sorted(waiting) if k == label]
            waiting = [x for x in waiting if x[0] != label]
    while waiting:
        label = min(waiting)[0]
        assert queue.pop(label) == [v for k, v in sorted(waiting) if k == label]
        waiting = [x for x in waiting if x[0] != label]
    assert queue.label() is None and not len(queue)
