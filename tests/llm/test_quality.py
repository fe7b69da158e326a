import random
import re
from collections import Counter

import corpus_pipeline
from rowmesh.llm import quality

SF = "/root/testdata/sf0.001"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len({i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(3)}),
    )


def plain(rows, line_docs=20, share=0.02, least=0.3):
    hosts, held = {}, {}
    split = lambda t: [x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")] if t is not None else []
    for i, host, t in rows:
        hosts.setdefault(host or "", set()).add(t)
        for line in split(t):
            held.setdefault((host or "", line.translate(A_Z)), []).append((t, i))
    often = {k: max((i for _, i in v if i is not None), default=None) for k, v in held.items() if len({t for t, _ in v}) > max(line_docs, share * len(hosts[k[0]]))}
    out = []
    for i, host, t in rows:
        n, *rest = counts(t)
        failed = n < 50 or 100 * rest[-1] > 50 * n
        lost = sum(len(x.split()) for x in split(t) if (k := (host or "", x.translate(A_Z))) in often and often[k] != i)
        out.append((i, n, *rest, failed, not failed and n - lost >= max(50, least * n)))
    return sorted(out, key=str)


def got(df):
    keep = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return sorted((tuple(r) for r in quality.judge(df).select("row.doc_id", *keep).collect()), key=str)


def test_like_counting_in_memory(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzé")
    menu = " ".join(f"menu{i}" for i in range(90))
    rows = [(i, "h", f"{menu}\n" + " ".join(word() + str(rng.randint(0, 99)) for _ in range(30))) for i in range(40)]
    rows += [(100 + i, "h", " ".join(f"{i}w{j}" for j in range(80))) for i in range(5)]
    rows += [(200 + i, "h", " ".join(f"copy{j}" for j in range(80))) for i in range(60)]  # exact copies count once
    rows += [(300, None, None), (301, "", ""), (302, "g", " \n\t\n"), (303, "g", "a b c " * 40), (304, "g", "x\nx\n x\nX # $ <b>"), (305, "g", "q w e r t q w e"), (None, "g", menu), (305, "g", menu), (306, "g", "é " * 30_000)]
    df = spark.createDataFrame([(i, h, t, 1, "k") for i, h, t in rows], "doc_id bigint, source string, text string, n_words int, lost string")
    want = plain(rows)
    assert got(df) == want
    assert {r[-1] for r in want if r[0] is not None and r[0] < 39} == {False} and all(r[-1] for r in want if r[0] is not None and 39 <= r[0] < 260)


def test_lines_above_the_limit_leave_the_text(spark):
    body = lambda i: "\n".join(" ".join(f"d{i}x{j}w{k}" for k in range(30)) for j in range(2))
    rows = [(i, "hot", f"  Home | Login \n{body(i)}\n\nhome | login\nShare this") for i in range(30)]
    rows += [(100, "cold", f"Home | Login\n{body(100)}"), (101, None, None), (102, "hot", ""), (None, "hot", f"share this\n{body(102)}")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = {r.doc_id: r for r in quality.judge(df, carry_text=True).select("row.*", "cleaned", "words_lost").collect()}
    for i, _, text in rows:
        want = f"{body(i)}\n" if i is not None and i < 29 else body(102) if i is None else text
        assert (got[i].text, got[i].cleaned) == (text, want)
    assert got[3].words_lost == 8 and got[29].words_lost == 0
    stage = {r.doc_id: r for r in corpus_pipeline.quality_rules(spark, df.selectExpr("doc_id", "text", "'en' lang", "source", "bigint(length(text)) n_chars"), SF).collect()}
    assert stage.keys() == got.keys() - {101, 102} and all(r.text == got[i].cleaned and r.n_chars == len(r.text) for i, r in stage.items())
    assert "cleaned" not in quality.judge(df).columns


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id bigint, source string, text string")).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r)[:8] for r in quality.query(spark, SF).collect()), key=str) == plain(rows)


def test_what_the_lines_leave_decides(spark, monkeypatch):
    """Documents that pass the base rules are rejected for their lines, and are not once the line counts are skipped."""
    made = [(i, "h", "Home Login Share Menu About Contact\n" * (i < 30) + " ".join(f"{i}w{j}" for j in range(47 if i % 2 else 80))) for i in range(60)]
    df = spark.createDataFrame(made, "doc_id bigint, source string, text string")
    assert got(df) == plain(made)
    rejected = {r[0] for r in got(df) if not r[-2] and not r[-1]}
    assert rejected == set(range(1, 29, 2))
    losses = quality.line_losses
    monkeypatch.setattr(quality, "line_losses", lambda *a, **k: losses(*a, **k).where("false"))
    assert not [r for r in got(df) if not r[-2] and not r[-1]]
