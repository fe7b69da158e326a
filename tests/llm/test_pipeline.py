import hashlib
from collections import Counter

import test_decontaminate
import test_line_dedup
import test_mixing
import test_quality
import test_simhash
from pyspark.sql import functions as F

import corpus_pipeline
from rowmesh.llm import common
from rowmesh.llm import decontaminate as D

SF = "/root/testdata/sf0.001"


def plain_mix(docs):
    sizes = {}
    for d in docs.values():
        sizes[d["source"]] = sizes.get(d["source"], 0) + len(d["text"].split())
    order = sorted(sizes, key=lambda s: s.encode())
    target = test_mixing.level(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, {s: 3 * n for s, n in sizes.items()})
    copies = {}
    for s in order:
        whole, before = int(target[s] // sizes[s]), 0
        part = target[s] - whole * sizes[s]
        for i in sorted((i for i, d in docs.items() if d["source"] == s), key=lambda i: hashlib.md5(f"mix-1:{i}".encode()).hexdigest()):
            n = len(docs[i]["text"].split())
            copies[i] = whole + (2 * before + n <= 2 * part)
            before += n
    return copies


def test_run_like_the_stages_in_memory(spark):
    docs = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r[0] for r in test_quality.plain([(i, d["source"], d["text"]) for i, d in docs.items()]) if r[-1]}
    docs = {i: d for i, d in docs.items() if i in good}
    for i, _, dropped, kept in test_line_dedup.plain([(i, d["text"]) for i, d in docs.items()]):
        if dropped:
            docs[i] |= {"text": kept, "n_chars": len(kept)}
    first = {i: c for i, _, c in test_simhash.plain_components([(i, test_simhash.plain_fingerprint(d["text"])) for i, d in docs.items()])}
    docs = {i: d for i, d in docs.items() if first[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [(k, t, set(test_decontaminate.bag(D.words_of(t)))) for k, t in items]
    dirty = set()
    for i, d in docs.items():
        own = set(test_decontaminate.bag(D.words_of(d["text"])))
        near = [(k, t) for k, t, g in grams if own & g]
        if near and test_decontaminate.plain(d["text"], near):
            dirty.add(i)
    docs = {i: d for i, d in docs.items() if i not in dirty}
    copies = plain_mix(docs)
    got = corpus_pipeline.run(spark, SF).collect()
    assert dirty and len(first) > len(docs)
    assert Counter(r.doc_id for r in got) == Counter({i: n for i, n in copies.items() if n})
    for r in got:
        assert {c: r[c] for c in corpus_pipeline.COLUMNS} == {c: docs[r.doc_id][c] for c in corpus_pipeline.COLUMNS} and 1 <= r.copy <= 3


def test_stages_on_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs.where("false"), docs.select("doc_id", F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars").limit(3)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, SF)
            assert out.columns[:5] == list(corpus_pipeline.COLUMNS)
            df = common.stored(out, "odd") if k < 4 else out
        assert df.count() == 0


def test_rows_that_share_an_id_go_by_their_own_text(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(200)) for k in "ABC"}
    rows = [(1, "A"), (2, "A"), (2, "B"), (3, "C"), (3, "C")]
    docs = spark.createDataFrame([(i, text[k], "en", "s", len(text[k])) for i, k in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text[0]) for r in got) == [(1, "A"), (2, "B"), (3, "C")]


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (9, 9), (500, 100), (2, 800), (800, 900), (-5, 900)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 100 for i in [*range(100, 161), 500]} | {3: 3, 7: 3, 2: -5, 800: -5, 900: -5, -5: -5}
    assert got == want
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
