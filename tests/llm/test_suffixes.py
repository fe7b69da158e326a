import hashlib
import random

import numpy as np
import pytest

from rowmesh.llm import suffixes

SF = "/root/testdata/sf0.01"
DOC = "doc_id bigint, text string"


def plain(rows, least=200):
    """(id, bytes, removed, spans, digest of the rest) by counting every window in memory."""
    data = [(i, (t or "").encode()) for i, t in rows]
    count: dict[bytes, int] = {}
    for _, b in data:
        for i in range(len(b) - least + 1):
            w = b[i : i + least]
            count[w] = count.get(w, 0) + 1
    out = []
    for key, b in data:
        covered = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if count[b[i : i + least]] > 1:
                covered[i : i + least] = b"\1" * least
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        rest = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out.append((key, len(b), sum(covered), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def got(df, **how):
    found = suffixes.repeats(df, **how).collect()
    return sorted(((r.id, r.n_bytes, sum(s.n for s in r.spans), len(r.spans), r.kept_sha256) for r in found), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    text = lambda n, letters="abcdefgh ": "".join(rng.choice(letters) for _ in range(n))
    passage, other = text(90), text(40, "äöü ß")
    made = [(i, text(rng.randrange(60))) for i in range(30)]
    made += [(100 + i, text(rng.randrange(20)) + passage[rng.randrange(20) : 70 + rng.randrange(20)] + text(rng.randrange(20))) for i in range(40)]
    made += [(200 + i, text(30) + other + text(9)) for i in range(5)] + [(300, passage + "x" + passage + other), (301, passage), (302, "aaaa" * 40), (303, "abab" * 9), (304, "a" * 25)]
    made += [(400, None), (401, ""), (402, "short"), (None, passage), (None, None), (7, passage), (7, passage), (403, "one long text of its own " + text(4000) + passage[:50])]
    return made


@pytest.mark.parametrize("how", [{"gram": 6}, {"gram": 1}, {"gram": 20}, {"gram": 5, "pieces": 3}, {"gram": 5, "pieces": 0}, {"gram": 8, "collection_bytes": 100}])
def test_like_counting_windows_in_memory(spark, rows, how):
    """Whatever the anchors, the size of collections, and with crowded anchors counted by hashes."""
    assert got(spark.createDataFrame(rows, DOC), least=20, **how) == plain(rows, 20)


def test_long_texts_are_cut_without_loss(spark, rows, monkeypatch):
    monkeypatch.setattr(suffixes, "BUFFER", 64)
    assert got(spark.createDataFrame(rows, DOC), least=20, gram=6) == plain(rows, 20)


def test_without_broadcasts(spark, rows, monkeypatch):
    monkeypatch.setattr(suffixes, "BROADCAST_BYTES", 0)
    assert got(spark.createDataFrame(rows, DOC), least=20, gram=6) == plain(rows, 20)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = suffixes.query(spark, SF)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(docs)


def test_clashing_columns_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, DOC)
    assert got(df.selectExpr("*", "1 AS uid", "2 AS ta", "3 AS id", "4 AS copies", "5 AS spans"), least=20, gram=6) == plain(rows, 20)
    assert got(df.limit(0)) == []
    with pytest.raises(ValueError):
        suffixes.repeats(df, least=300, gram=4)


def test_columns_are_sorted_and_know_their_common_prefixes():
    """Each round against sorting the suffixes of a column, group by group."""
    rng = random.Random(5)
    for _ in range(80):
        letters = rng.choice([b"ab", b"abc", bytes(range(256))])
        base = bytes(rng.choice(letters) for _ in range(40))
        group = np.sort([rng.randrange(3) for _ in range(rng.randrange(1, 14))])
        cuts = [(rng.randrange(20), rng.randrange(20, 40)) for _ in group]
        pieces = [base[i:20] + bytes(rng.choice(letters) if rng.random() < 0.1 else x for x in base[20:j]) or b"x" for i, j in cuts]
        place = np.array([min(20 - i, len(p) - 1) for (i, _), p in zip(cuts, pieces, strict=True)])
        symbols, left = suffixes.columns(pieces, place)
        order, shared = np.arange(len(pieces)), np.zeros(len(pieces), np.int32)
        for column in range(len(symbols) - 1, -1, -1):
            order, shared = suffixes.insert(symbols[column], group, order, shared, 6)
            start = column - left + place  # of the suffix of each piece
            there = [0 <= start[i] < len(pieces[i]) for i in order]
            text = [pieces[i][start[i] :] if t else None for i, t in zip(order, there, strict=True)]
            assert group[order].tolist() == group.tolist()
            for k in range(1, len(order)):
                x, y = text[k - 1], text[k]
                if group[k] != group[k - 1] or x is None or y is None:
                    assert shared[k] == 0
                    continue
                n = next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
                assert shared[k] == min(n, 6) and x[: n + 1] <= y[: n + 1]
        found = set(zip(*(x.tolist() for x in suffixes.repeated(pieces, place, group, 6)), strict=True))
        count = {}
        for i, p in enumerate(pieces):
            for j in range(len(p) - 5):
                count.setdefault((group[i], j - place[i], p[j : j + 6]), []).append((i, j))
        assert found == {w for ws in count.values() if len(ws) > 1 for w in ws}
