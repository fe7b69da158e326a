import random
from collections import Counter

import numpy as np
import pytest

from rowmesh.llm import decontaminate as D

SF = "/root/testdata/sf0.001"


def bag(w):
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def plain(text, items):
    """All windows of all sizes against all items."""
    words, best = D.words_of(text), {}
    for key, item in items:
        w = D.words_of(item)
        for s in range(len(words) - len(w) + 1 if w else 0):
            a, b = bag(words[s : s + len(w)]), bag(w)
            similar = sum((a & b).values()) / sum((a | b).values())
            if similar >= 0.8 and similar > best.get(key, (0,))[0]:
                best[key] = (similar, s)
    return {(k, s, round(x, 9)) for k, (x, s) in best.items()}


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([18, 18, 25, 40, 46, 60, 60, 3, 5, 7])] + [(20, "a b a b a b a b a b a b a b"), (21, None), (22, ""), (23, "..."), (24, "Same, text of six words here"), (25, "same text OF six words here!")]
    docs = []
    for key, text in items[:10]:
        w = text.split()
        edited = list(w)
        if len(w) > 40:
            edited[len(w) // 2] = "changed"
        docs += [f"{item(30)} {text.upper()}. {item(20)}", f"{item(9)} " + " | ".join(w), " ".join(edited) + " tail", " ".join(w[: len(w) // 2]), item(5) + " " + " ".join(w[1:])]
    docs += [None, "", "...", "a b " * 500, "x " * 60_000 + items[3][1], "Same text of six words here", item(300), items[4][1] + " " + items[4][1]]
    return items, docs


def test_like_all_windows(spark, case):
    items, docs = case
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(docs)] + [(0, docs[0], 3), (None, docs[1], 3)], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([*items, items[0], (None, "w1 w2 w3 w4 w5 w6")], "item_id bigint, text string")
    want = [(i, t) for i, t in [*enumerate(docs), (0, docs[0]), (None, docs[1])]]
    want = sorted(((i, *x) for i, t in want if t is None or len(t) < 100_000 for x in plain(t, items)), key=str)
    want = sorted([*want, (docs.index("x " * 60_000 + items[3][1]), 3, 60_000, 1.0)], key=str)
    for words in (2_000_000, 60):
        got = D.matches(df, bench, block_words=words)
        assert sorted(((r.id, r.item_id, r.first_word, round(r.similarity, 9)) for r in got.collect()), key=str) == want
    left = D.clean(df, bench).collect()
    hit = {i for i, *_ in want}
    assert {r.doc_id for r in left} == {i for i in range(len(docs)) if i not in hit} and all(r.item_id == 3 for r in left)


def test_texts_shorter_than_the_item(spark):
    rng = random.Random(23)
    items = [(i, " ".join(f"w{rng.randint(0, 300)}" for _ in range(n))) for i, n in enumerate([59, 59, 40, 30, 7, 6, 4])]
    docs = []
    for _, text in items:
        w = text.split()
        docs += [" ".join(w[:-j]) for j in (1, 2, 6, 12) if j < len(w)] + [" ".join(w[2:]), " ".join(w[: len(w) // 2] + w[len(w) // 2 + 1 :])]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    want = []
    for i, text in enumerate(docs):
        words = D.words_of(text)
        for key, item in items:
            w = item.split()
            if len(words) < len(w):  # the others are the windows of the tests above
                k = min(5, len(w))
                a, b = (Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1)) for x in (words, w))
                similar = sum((a & b).values()) / sum((a | b).values())
                want += [(i, key, 0, len(words), round(similar, 9))] if similar >= 0.8 else []
    got = [(r.id, r.item_id, r.first_word, r.words, round(r.similarity, 9)) for r in D.matches(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()]
    assert sorted(got) == want and (1, 0, 0, 57, round(53 / 55, 9)) in want
    left = {r.doc_id for r in D.clean(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert left == set(range(len(docs))) - {x[0] for x in want}


def test_blocks_miss_no_fingerprint_within_the_radius():
    rng = np.random.default_rng(3)
    items = D.Items([(i, " ".join(f"u{rng.integers(900)}" for _ in range(30))) for i in range(40)])
    (group,) = items.groups
    prints = []
    for _ in range(300):
        x = group.prints[int(rng.integers(40))]
        for b in rng.choice(64, int(rng.integers(0, D.RADIUS + 1)), replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        prints.append(x)
    wanted = rng.random(40) < 0.7
    got = sorted(x for w, i, d in group.near(np.array(prints), wanted) for x in zip(w.tolist(), i.tolist(), d.tolist(), strict=True))
    apart = np.bitwise_count(np.array(prints)[:, None] ^ group.prints[None, :])
    assert got == sorted((w, i, int(apart[w, i])) for w, i in np.argwhere((apart <= D.RADIUS) & wanted[None, :]).tolist()) and len(got) > 200


def test_recall_of_edited_passages():
    """Items of 40 to 60 words among others of their sizes, with words changed or left out, at similarities from 0.8 on."""
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdefghijklmnopqrst") + str(rng.randint(0, 99)) for _ in range(rng.randint(40, 60)))) for i in range(400)]
    block = D.Items(items)
    numbers = D.Numbers(block.vocabulary)
    seen: dict[int, list[bool]] = {}
    for key, text in items:
        for edits in (1, 1, 2, 2):
            w = text.split()
            for _ in range(edits):
                at = rng.choice([0, 1, 2, 3, len(w) - 1, len(w) - 2, rng.randrange(len(w))])
                w[at : at + 1] = rng.choice([["other"], [], ["two", "more"]])
            doc = " ".join([*(f"x{rng.randint(0, 999)}" for _ in range(20)), *w, *(f"y{rng.randint(0, 999)}" for _ in range(20))])
            want = {k: x for k, _, x in plain(doc, [(key, text)])}
            got = {k: round(x, 9) for k, _, _, x, _ in block.find(D.numbered(doc, numbers))}
            if want:
                seen.setdefault(int(want[key] * 20 + 1e-9), []).append(got.get(key) == want[key])
    assert all(len(seen[band]) >= 30 for band in (16, 17, 18)) and all(sum(x) >= 0.9 * len(x) for x in seen.values())
    assert sum(map(sum, seen.values())) >= 0.99 * sum(map(len, seen.values()))


def test_the_order_of_items_makes_no_difference():
    rng = random.Random(8)
    items = [(i, " ".join(f"v{rng.randint(0, 60)}" for _ in range(24))) for i in range(30)]
    docs = [" ".join([items[i][1], items[i + 1][1].replace("v7 ", "v8 ")]) for i in range(29)]
    results = []
    for some in (items, items[::-1], rng.sample(items, 30)):
        block = D.Items(some)
        results.append([block.find(D.numbered(t, D.Numbers(block.vocabulary))) for t in docs])
    assert results[0] == results[1] == results[2] and any(x[4] for found in results[0] for x in found) and all(results[0])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.matches(docs, none).count() == 0 and D.clean(docs, none).count() == 1
    assert D.matches(docs.where("false"), none.union(spark.createDataFrame([(1, "a b c d e f")], none.schema))).count() == 0


def test_query_in_memory(spark):
    """All windows against all items that share a shingle with the document."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bags = [(k, t, set(bag(D.words_of(t)))) for k, t in items]
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        own, n = D.words_of(r.text), len(D.words_of(r.text))
        grams = set(bag(own))
        near = [(k, t) for k, t, g in bags if grams & g]
        want += [(r.doc_id, *x) for x in plain(r.text, [(k, t) for k, t in near if len(D.words_of(t)) <= n])]
        for k, t in near:
            if len(D.words_of(t)) > n >= 5:
                a, b = bag(own), bag(D.words_of(t))
                similar = sum((a & b).values()) / sum((a | b).values())
                want += [(r.doc_id, k, 0, round(similar, 9))] if similar >= 0.8 else []
    got = sorted((r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in D.query(spark, SF).collect())
    assert got == sorted(want) and got
