"""Hard negatives against all scores."""

import numpy as np
import pytest

from veldspar.llm import hard_negatives, vectors

ROW = "vec_id long, label int, embedding array<double>, v string, cell int, d string"


def plain(rows, scale=256, every=100):
    """(anchor, positive, rank, negative, scores) by all scores in Python's integers."""
    good = []
    for i, label, e in rows:
        if i is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e):
            good.append((i, label, tuple(int(x) for x in vectors.whole(np.array(e, float), scale))))
    out = []
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for a in {g for g in good if g[0] % every == 0}:
        scored = sorted((-clip(sum(x * y for x, y in zip(a[2], g[2], strict=True))), g[0], g[1]) for g in good if len(g[2]) == len(a[2]))
        for p in [s for s in scored if s[2] == a[1] and s[1] != a[0]][:5]:
            for r, n in enumerate([s for s in scored if s[2] != a[1] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5], 1):
                out.append((a[0], p[1], r, n[1], -p[0], -n[0]))
    return sorted(out)


def mined(spark, rows, **more):
    got = hard_negatives.mined(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], ROW), **more)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("cell_rows, anchors, lanes", [(4096, 4096, 1 << 15), (40, 5, 300)])
def test_equal_to_all_scores(spark, monkeypatch, cell_rows, anchors, lanes):
    for name, value in (("ANCHORS", anchors), ("LANE_ROWS", lanes), ("BATCH", 64)):
        monkeypatch.setattr(hard_negatives, name, value)
    plain_space, plain_groups = hard_negatives.space_of, hard_negatives.groups
    monkeypatch.setattr(hard_negatives, "space_of", lambda rows: plain_space(rows, cell_rows=cell_rows))
    monkeypatch.setattr(hard_negatives, "groups", lambda counts, space: plain_groups(counts, space, anchors))
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 6)) * r.uniform(0.2, 4, size=(12, 1))
    rows = [(int(i), int(r.integers(0, 4)), (centres[i % 12] + 0.2 * r.normal(size=6)).tolist()) for i in r.permutation(900)]
    rows += [(i, 1, [0.5] * 6) for i in (1000, 1001, 1002, 1003, 1003)] + [(1100, 2, [0.5] * 6)] * 3  # ties and repeats
    rows += [(1200, 3, [1.0, 2.0]), (1201, 3, [1.0, 1.5]), (1202, 4, [1.0, 1.4]), (1204, 9, [0.0, 0.0])]  # another length
    rows += [(1300, 7, [1e200] * 6), (1301, 7, [1e30] * 6), (1302, 8, [1e30, *[0.1] * 5]), (1400, 5, [-1.0] * 6)]  # huge
    rows += [(1500, None, [1.0] * 6), (None, 1, [1.0] * 6), (1501, 1, None), (1502, 1, []), (1503, 1, [None] * 6), (1504, 1, [float("nan")] * 6), (1505, 1, [float("inf")] * 6)]
    want = plain(rows)
    assert mined(spark, rows) == want and len(want) > 100


def test_pruning_copies_less(spark):
    """Far clusters of other labels aren't copied to groups that can't need them."""
    r = np.random.default_rng(8)
    centres = 20 * np.eye(8)
    rows = spark.createDataFrame([(i, i % 8, (centres[i % 8] + r.normal(size=8)).tolist()) for i in range(1600)], "vec_id long, label int, embedding array<double>")
    held = hard_negatives.prepared(rows, 256)
    space = hard_negatives.space_of(held, cell_rows=50)
    celled = hard_negatives._celled(held, space, False)
    d = {tuple(x) for x in celled.select("label", "cell").distinct().collect()}
    assert len({c for _, c in d}) == len(d)  # no cell holds two clusters
    asked = hard_negatives._celled(held.where("vec_id % 100 = 0").withColumn("aid", hard_negatives.F.col("vec_id")), space, True)
    stats = asked.groupBy("cell").agg(hard_negatives.F.count("*").alias("n"), hard_negatives.F.min("d").alias("a"), hard_negatives.F.max("d").alias("b")).collect()
    dealt = hard_negatives.groups({x.cell: x.n for x in stats}, space, 1)
    ranges = {x.cell: (x.a, x.b) for x in stats}
    copied = []
    plain_copied = hard_negatives._copied
    try:
        hard_negatives._copied = lambda *a: copied.append(plain_copied(*a)) or copied[-1]
        hard_negatives.positives(celled.withColumn("asked", hard_negatives.F.expr("vec_id % 100 = 0")), asked, space, dealt, ranges, 1, 5)
    finally:
        hard_negatives._copied = plain_copied
    n = copied[0].select(hard_negatives.F.sum(hard_negatives.F.expr("length(ids) / 8"))).first()[0]
    assert n < 0.5 * 1600 * 16  # sixteen anchors, a group each


def test_empty_table(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []
