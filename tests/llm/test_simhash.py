import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rowmesh.llm import simhash

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=3):
    """rows: (id, fingerprint); by all pairs."""
    label = {f: f for _, f in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    prints = sorted(label)
    for i, x in enumerate(prints):
        for y in prints[i + 1 :]:
            if (x ^ y).bit_count() <= radius:
                label[find(y)] = find(x)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f, least.get(find(f))) for i, f in rows), key=str)


def components_of(spark, prints, **how):
    df = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)),) for f in prints], "fp bigint")
    links = [tuple(np.array(r, np.int64).view(np.uint64).tolist()) for r in simhash.fingerprint_links(df, **how).collect()]
    label = {f: f for f in prints}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[find(b)] = find(a)
    groups = {}
    for f in prints:
        groups.setdefault(find(f), set()).add(f)
    return sorted(map(sorted, groups.values()))


def test_fingerprint_is_the_plain_one():
    for text in (None, "", " \n\t", "One", "one two", "É a B c\x0bd e É A b", "x " * 300, "a b c d e f g " * 40):
        assert simhash.text_fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_golay_code_is_perfect():
    parity, error = simhash.golay()
    assert min(((m << 11) | int(parity[m])).bit_count() for m in range(1, 4096)) == 7
    words = np.arange(0, 1 << 23, 4099, dtype=np.uint32)
    index = simhash.segment_indices(words, 23)
    assert {len(set(r)) for r in index.tolist()} == {1, 6}


def test_any_pair_within_three_bits_shares_a_key():
    rng = random.Random(7)
    for _ in range(600):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        _, kx = simhash.bucket_keys(np.array([x], np.uint64))
        _, ky = simhash.bucket_keys(np.array([y], np.uint64))
        assert set(kx.tolist()) & set(ky.tolist())
        assert len(set(kx.tolist())) == len(kx)


@pytest.mark.parametrize(("limit", "radius"), [(4096, 3), (3, 3), (3, 2), (3, 1), (3, 0), (12, 3), (4096, 1)])
def test_links_connect_like_all_pairs(spark, limit, radius):
    """With a limit of three, the dense way takes the large groups; with twelve, the third segment deals some of them out."""
    rng = random.Random(limit)
    prints = set()
    for size in [1] * 60 + [2] * 20 + [30, 45]:
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            prints.add(x)
    chain = rng.getrandbits(64)
    for step in range(12):
        prints.add(chain)
        for b in rng.sample(range(64), 3):
            chain ^= 1 << b
    prints = sorted(prints)
    want = {}
    for i, f, c in plain_components([(k, f) for k, f in enumerate(prints)], radius):
        want.setdefault(c, []).append(f)
    assert components_of(spark, prints, bucket_limit=limit, radius=radius) == sorted(map(sorted, want.values()))


def test_table_with_every_odd_case(spark):
    rng = random.Random(3)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 90)) for _ in range(300)]
    texts = [" ".join(base), " ".join(base).upper(), " ".join([*base[:150], "changed", *base[151:]]), None, "", " \n", "one", "ONE", "z " * 50_000]
    rows = [(10 + i, t, "x") for i, t in enumerate(texts)] + [(None, "one", "x"), (10, texts[0], "x"), (None, "alone among nulls here", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = sorted(((r.id, r.fp % 2**64, r.component) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == plain_components([(i, plain_fingerprint(t)) for i, t, _ in rows])
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_sub_keys_of_any_pair_within_three_bits_meet():
    rng = random.Random(17)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        sub = []
        for v in (x, y):
            rows, keys = simhash.bucket_keys(np.array([v], np.uint64))
            batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.array([v] * len(keys), np.uint64).view(np.int64))], ["key", "fp"])
            sub.append({k for out in simhash._sub_keys([batch]) for k in out.column(0).to_pylist()})
        assert sub[0] & sub[1]


def test_one_row_of_each_group_is_left(spark):
    long = {k: " ".join(f"{k}{i}" for i in range(200)) for k in "abcd"}
    rows = [(1, long["a"], "x"), (2, long["a"], "x"), (2, long["b"], "x"), (3, long["c"], "x"), (3, long["c"], "x"), (3, long["c"], "y"), (None, long["d"], "x"), (None, long["d"], "z"), (None, long["a"], "x"), (9, None, "x"), (8, "", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row_a string")
    got = simhash.representatives(df)
    assert got.columns == df.columns
    left = sorted((r.doc_id, (r.text or "")[:1]) for r in got.collect() if r.doc_id is not None)
    assert left == [(1, "a"), (2, "b"), (3, "c"), (8, "")] and got.where("doc_id is null").select("text").collect() == [(long["d"],)]
    assert simhash.representatives(df.where("false")).count() == 0


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs])
    got = simhash.query(spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got.collect()), key=str) == want
    assert got.where(F.length("fingerprint") != 16).count() == 0
