import hashlib
import random
import zlib

import pytest

from rowmesh.llm import trie

SF = "/root/testdata/sf0.001"
CONV = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    """The turns of each conversation; ties go in the order of the rows."""
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    return convs


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain(convs):
    """The nodes by walking each path in memory."""
    nodes = {}
    for c in sorted(convs):
        path = tuple(convs[c])
        for d in range(len(path) + 1):
            node = nodes.setdefault(path[:d], {"members": [], "ends": [], "kids": set()})
            node["members"].append(c)
            if d < len(path):
                node["kids"].add(path[: d + 1])
            else:
                node["ends"].append(c)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        node = nodes[path]
        leaves[path] = sum(leaves[k] for k in node["kids"]) or 1
        saved[path] = (len(node["members"]) - 1) * (len(path[-1][1].encode()) if path else 0) + sum(saved[k] for k in node["kids"])
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        ((n["members"][0], len(p), nodes[p[:-1]]["members"][0] if p else None, len(n["members"]), len(n["kids"]), leaves[p], saved[p], digest(n["ends"])) for p, n in nodes.items()), key=str
    )


def got(turns, convs, **how):
    found = trie.prefix_trie(turns, convs, **how)
    sha = {(r.depth, r.a, r.b): r.sha for r in trie.ends_sha256(found).collect()}
    digest = lambda r: sha.get((r.depth, r.a, r.b)) or hashlib.sha256(("" if r.end_conv is None else str(r.end_conv)).encode()).hexdigest()
    return sorted(((r.conv, r.depth, r.parent_conv, r.n_convs, r.children, r.leaves, r.tokens, digest(r)) for r in found.nodes.collect()), key=str)


def as_they_are(df):
    turns = trie.numbered_turns(df)
    sizes = trie.lengths(turns).withColumnRenamed("n", "size")
    return turns.join(sizes, "conv").selectExpr("conv", "pos + 1 AS depth", "x", "y", "bytes", "size"), sizes


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no", "ü" * 9])) for c in range(60) for t in range(rng.randrange(1, 13))]
    made += [(100 + c, t, "user", "the same opening") for c in range(40) for t in range(3)]
    made += [(100 + c, 3 + t, None, f"own {c} {t}" if t % 2 else None) for c in range(0, 40, 3) for t in range(4)]
    made += [(200, t, "user", f"long {t // 2}") for t in range(90)] + [(205, t, "user", f"long {t // 2}" if t < 50 else "other") for t in range(80)]
    made += [(7000 + i, None, "user", "no number") for i in (0, 1, 2)] + [(300, None, "a", "first"), (300, -5, "b", "second"), (300, 0, "c", "third")]
    made += [(400, 1, "user", "repeated")] * 6 + [(None, 1, "user", "nobody's"), (None, None, None, None), (-3, 0, "user", "below"), (-4, 0, "user", "below"), (0, 99, "", "")]
    return made


def test_query_rule_like_walking_in_memory(spark, rows):
    df = spark.createDataFrame(rows, CONV)
    turns = trie.numbered_turns(df)
    # -3 - (-3) % 5 differs between languages; the operator takes SQL's remainder, whose sign is the dividend's
    convs = sequences(rows)
    want = {c: (convs.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[: zlib.crc32(str(c).encode()) % 9]) + own[zlib.crc32(str(c).encode()) % 9 :] for c, own in convs.items()}
    assert got(*trie.rebuilt(turns)) == plain(want)


@pytest.mark.parametrize("how", [{}, {"shard_turns": 5}, {"shard_turns": 30, "scan": 7}, {"band": 4, "shard_turns": 20}, {"band": 1, "shard_turns": 1}, {"band": 16, "scan": 3}])
def test_cuts_do_not_matter(spark, rows, how):
    """Heavy nodes, bands with shards below shards, and scans in blocks give the trie that walking gives."""
    assert got(*as_they_are(spark.createDataFrame(rows, CONV)), **how) == plain(sequences(rows))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = trie.query(spark, SF)
    assert found.columns == COLUMNS and [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rebuilt(sequences(rows)))


def test_long_lists_of_ends(spark, monkeypatch):
    """Many copies of one conversation end at one node; their list is hashed in pieces."""
    monkeypatch.setattr(trie, "CHUNK", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(500) for t in range(2)]
    assert got(*as_they_are(spark.createDataFrame(rows, CONV))) == plain(sequences(rows))


def test_clashing_columns_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, CONV)
    named = df.selectExpr("*", "1 AS pos", "2 AS conv", "3 AS a", "4 AS depth", "5 AS size")
    assert got(*as_they_are(named)) == plain(sequences(rows))
    assert got(*as_they_are(df.limit(0))) == [] and got(*trie.rebuilt(trie.numbered_turns(df.limit(0)))) == []
