"""Hard negatives against brute force; trees keep the cover tree's invariants."""

import math

import numpy as np
from pyspark.sql import functions as F

from potentia.llm import covertree

COLS = "vec_id long, label int, embedding array<float>, score double, x int, rank string"


def brute(rows, positives=5, negatives=10):
    seen = {}
    for vec, label, e in rows:
        if vec is None or label is None or e is None or any(c is None or not math.isfinite(c) for c in e):
            continue
        label = (label + 1) % 10 if vec % 7 == 0 else label
        seen[vec, label, tuple(math.floor(256 * float(np.float32(c))) for c in e)] = 1
    rows = list(seen)
    out = []
    for a, la, xa in rows:
        if a % 100:
            continue
        score = [(-sum(p * q for p, q in zip(xa, x)), v, lab) for v, lab, x in rows if len(x) == len(xa)]
        for ps, pos, _ in sorted(s for s in score if s[2] == la and s[1] != a)[:positives]:
            window = sorted(s for s in score if s[2] != la and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:negatives]
            out += [(a, pos, r + 1, v, -ps, -s) for r, (s, v, _) in enumerate(window)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 1, "r") for r in rows], COLS)


def mined(spark, rows, **kw):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = covertree.mine(rows, F.col("vec_id") % 100 == 0, relabel=moved, **kw)
    return sorted(tuple(r) for r in df.collect())


def clustered(n=1500, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.15
    x[::9] *= 3
    return [(int(i), int(rng.integers(0, 4)), [float(c) for c in v]) for i, v in enumerate(x)]


def odd():
    rows = clustered(300, 3, 5)
    rows += [(1000 + i, i % 3, [0.5, 0.25, -1.0]) for i in range(120)]  # a group of equal vectors, an anchor in it
    rows += rows[:40]  # repeated rows
    rows += [(None, 1, [1.0, 0.0, 0.0]), (2000, None, [1.0, 0.0, 0.0]), (2100, 1, None), (2200, 1, [1.0, None, 0.0]),
             (2300, 1, [float("nan"), 0.0, 0.0]), (2400, 1, [float("inf"), 0.0, 0.0]), (2500, 1, [0.0, 0.0, 0.0]), (2501, 2, [0.0, 0.0, 0.0])]
    rows += [(2600, 1, []), (2601, 1, []), (2602, 2, []), (2700, 1, [1.0, 2.0]), (2701, 1, [2.0, 2.0]), (2702, 3, [1.0, 0.5])]
    rows += [(2800, 1, [1.0, 1.0, 1.0]), (2800, 1, [1.0, 1.0, 0.9]), (2800, 2, [1.0, 1.0, 0.8])]  # one id, several rows
    return rows


def test_mined_equals_brute_force(spark):
    rows = clustered()
    want = brute(rows)
    assert len(want) > 500
    assert mined(spark, frame(spark, rows)) == want
    # many cells, chunks and leaves, any partitioning
    assert mined(spark, frame(spark, rows).repartition(9), cell_rows=100, chunk_rows=150) == want


def test_odd_rows(spark):
    rows = odd()
    want = brute(rows)
    assert {r[0] for r in want} >= {1000, 1100, 2500, 2600, 2800}
    assert mined(spark, frame(spark, rows), cell_rows=64) == want


def test_no_rows_and_no_anchor(spark):
    assert mined(spark, frame(spark, [])) == []
    assert mined(spark, frame(spark, [(1, 1, [1.0]), (2, 2, [1.0])])) == []


def test_tree_invariants():
    x = np.array([r[2] for r in clustered(4000, 5, 3)])
    t = covertree.build(x)
    assert sorted(t["order"]) == list(range(len(x))) and len(np.unique(t["level"])) > 3
    for k in range(len(t["centre"])):
        rows = t["order"][t["start"][k]:t["end"][k]]
        away = np.linalg.norm(x[rows] - x[t["centre"][k]], axis=1)
        assert away.max() <= t["radius"][k] * (1 + 1e-9) and t["centre"][k] in rows
        kids = np.flatnonzero(t["parent"] == k)
        if not len(kids):
            assert t["leaf"][k]
            continue
        assert t["centre"][kids[0]] == t["centre"][k]  # nesting
        assert (t["end"][kids] - t["start"][kids]).sum() == len(rows)
        c = x[t["centre"][kids]]
        gap = np.linalg.norm(c[:, None] - c[None], axis=2)[np.triu_indices(len(kids), 1)]
        if len(kids) < covertree._FAN:  # covering and separation
            assert t["radius"][kids].max() <= t["radius"][k] / covertree.BASE * (1 + 1e-9)
            assert gap.min() > t["radius"][k] / covertree.BASE * (1 - 1e-9)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.array([r[2] for r in clustered(4000, 5, 3)]))
    sphere = float(np.square(x).sum(axis=1).max() + 1)
    t = covertree.build(covertree._augmented(x, sphere))
    q = x[rng.choice(len(x), 40)]
    ip = q @ x.T
    least, most = covertree.bounds(q @ x[t["centre"]].T, np.linalg.norm(q, axis=1), t["radius"], sphere)
    for k in range(len(t["centre"])):
        rows = t["order"][t["start"][k]:t["end"][k]]
        assert (ip[:, rows] >= least[:, k:k + 1]).all() and (ip[:, rows] <= most[:, k:k + 1]).all()
    leaves = np.flatnonzero(t["leaf"])
    tenth = np.sort(ip, axis=1)[:, -10]
    sizes = (t["end"] - t["start"])[leaves]
    assert ((most[:, leaves] >= tenth[:, None]) * sizes).sum() < 0.5 * ip.size  # most members are never verified


def test_large_components_are_exact():
    big = 1 << 27
    q = np.array([[big, big - 1, 3.0]])
    x = np.array([[big - 3, big, 7.0], [-big, 5.0, 1.0]])
    got = covertree.product(q, x, float(3 * big * big))
    assert got.tolist() == [[sum(int(a) * int(b) for a, b in zip(q[0], r)) for r in x]]
