import random
import re

import pytest

from rowmesh.llm import licenses

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIT = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 100)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_Z))


def base(text):
    w, found = words(text), []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(found), min(found, default=(None,))[0], max(found, default=(None,))[0], ",".join(sorted({x for _, x in found}))


@pytest.fixture(scope="module")
def scanned(spark):
    changed = MIT.split()
    changed[20:20] = ["three", "more", "words"]
    changed[50] = "another"
    texts = [
        None,
        "",
        "...",
        "MIT License mit  license, MIT-LICENSE x",
        "Licensed under CC BY-NC 4.0.",
        "intro é words. " + MIT + " outro",
        "z " * 40_000 + " ".join(changed),
        "Apache é License, then Apache, License",
        " ".join(MIT.split()[:20]),
        "GNU General Public License, version 3 " * 3,
    ]
    rows = [(i, t, "l") for i, t in enumerate(texts)] + [(4, texts[4], "l"), (4, "plain", "l"), (None, texts[4], "l")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, labels string")
    return texts, licenses.scan(df).collect()


def of(scanned, i):
    return next(r for r in scanned[1] if r.id == i)


def test_base_counts_are_the_plain_ones(scanned):
    texts, rows = scanned
    assert len(rows) == len(texts) + 3
    for i, t in enumerate(texts):
        r = of(scanned, i)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t)


def test_spans(scanned):
    assert [of(scanned, i).labels for i in (0, 1, 2, 3, 7, 8)] == ["", "", "", "mit", "apache", ""]
    assert of(scanned, 4).labels == "cc-by,cc-by-nc-4.0" and of(scanned, 9).labels == "gpl,gpl-3.0"
    exact, edited = of(scanned, 5), of(scanned, 6)
    assert exact.labels == "mit" and exact.n_base == 0 and exact.score == 1.0
    assert [(s["first"], s["last"]) for s in exact.spans] == [(3, 2 + len(words(MIT)))]
    assert edited.labels == "mit" and 0.8 < edited.score < 1 and edited.spans[0]["first"] == 40_000
    assert all(0 <= r.score <= 1 for r in scanned[1])
    assert sorted(r.labels for r in scanned[1] if r.id == 4) == ["", "cc-by,cc-by-nc-4.0", "cc-by,cc-by-nc-4.0"]


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_more_template_words_than_are_broadcast(spark):
    """Five hundred whole bodies, some alike, against voting in memory."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 6)))
    bodies = [[word() for _ in range(430)] for _ in range(490)]
    bodies += [b[:200] + [word()] + b[200:] for b in bodies[:10]]
    templates = [(f"label-{i}", " ".join(b)) for i, b in enumerate(bodies)]
    assert sum(len(t.split()) for _, t in templates) > licenses.MOST_TEMPLATE_WORDS and not licenses.few_words(templates)
    filler = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{filler(20)} {templates[i][1]} {filler(9)}" for i in (0, 17, 489)] + [" ".join(bodies[40][:300]), " ".join(bodies[41][:150]), filler(900), None]
    texts += [" ".join(x for j, x in enumerate(bodies[60]) if j % 40), f"{templates[70][1]}. {templates[71][1].upper()}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.id: r for r in licenses.scan(df, templates=templates).collect()}
    places = {}
    for i, b in enumerate(bodies):
        for j in range(len(b) - 3):
            places.setdefault(tuple(b[j : j + 4]), []).append((i, j))
    for i, text in enumerate(texts):
        w, votes = words(text), {}
        for at in range(len(w) - 3):
            for t, place in places.get(tuple(w[at : at + 4]), []):
                votes.setdefault(t, {}).setdefault(at - place, []).append((at, place))
        want = set()
        for t, lines in votes.items():
            spans, last = [], None
            for d in sorted(lines):
                spans = [*spans, []] if last is None or d - last > 8 else spans
                spans[-1] += lines[d]
                last = d
            for span in spans:
                grams = len(bodies[t]) - 3
                first, end = min(a for a, _ in span), max(a for a, _ in span) + 3
                if len({p for _, p in span}) / grams >= 0.6 and end - first + 1 <= 1.5 * (grams + 3):
                    want.add((first, end, f"label-{t}"))
        assert {(s["first"], s["last"], s["label"]) for s in found[i].spans or []} == want
    assert [bool(found[i].spans) for i in range(9)] == [True, True, True, True, False, False, False, True, True] and len(found[8].spans) == 2
