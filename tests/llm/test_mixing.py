import pytest

from rowmesh.llm import mixing


def level(sizes, weights, caps):
    """Clamp and reshare until no target is above its cap."""
    targets, full, total = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in sizes if s not in full]
        rest = total - sum(caps[s] for s in full)
        targets = {s: caps[s] if s in full else rest * weights[s] / sum(weights[f] for f in free) for s in sizes}
        over = {s for s in free if targets[s] > caps[s]}
        if not over:
            return targets
        full |= over


@pytest.mark.parametrize("share", [1.0, 0.4])
def test_targets_and_takings(spark, share):
    rows = [(1000 * k + i, s, "w " * (1 + (7 * i + k) % 11)) for k, (s, n) in enumerate([("a", 400), ("b", 3), ("c", 90), ("d", 1), (None, 60), ("é", 30)]) for i in range(n)]
    rows += [(1, "a", None), (2, "a", ""), (3, "empty", None), (4, "d", "x " * 5000), (None, "c", "n n n"), (1005, "c", "again"), (1005, "c", "again")]
    df = spark.createDataFrame([(i, s, t, 7) for i, s, t in rows], "doc_id bigint, source string, text string, size int")
    got = mixing.mix(df, share=share).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = level(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, {s: 3 * n for s, n in sizes.items()}) if share == 1 else None
    for s in sizes:
        mine = [r for r in got if r["row"]["source"] == s]
        target, taken = mine[0]["target"], sum(r["copies"] * r["size"] for r in mine)
        if want:
            assert target == pytest.approx(want[s])
        assert {r["source_size"] for r in mine} == {sizes[s]} and all(0 <= r["copies"] <= 3 for r in mine)
        assert max(r["copies"] for r in mine) - min(r["copies"] for r in mine) <= 1
        assert abs(taken - target) <= max(r["size"] for r in mine) / 2 + 1
    again = {(r["row"]["doc_id"], r["size"]): r["copies"] for r in mixing.mix(df.repartition(5), share=share).collect()}
    assert again == {(r["row"]["doc_id"], r["size"]): r["copies"] for r in got}


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, source string, text string")).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "a", None)], "doc_id bigint, source string, text string")).first()
    assert (got["target"], got["copies"]) == (0.0, 0)
