"""Operator 12 against its SQL and brute force."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("strandlake.llm")
from strandlake.llm import negatives, queries  # noqa: E402

NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def got(df):
    return sorted(tuple(r[x] for x in NAMES) for r in df.collect())


def brute(rows, every, positives=5, negatives=10, scale=256):
    use = [(i, y, [math.floor(scale * x) for x in v]) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, y, v in use:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for i, (y, v) in anchors.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), j, z == y) for j, z, w in use if j != i and len(w) == len(v))
        for p, j, _ in [x for x in s if x[2]][:positives]:
            fit = [(j, n) for n, j, same in s if not same and -30 * p <= -100 * n <= -90 * p][:negatives]
            out += [(i, j, k + 1, m, -p, -n) for k, (m, n) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = c.execute(f"SELECT {', '.join(NAMES)} FROM ({queries.ORACLE_SQL['op12_hard_negatives']})").fetchall()
    assert len(want) > 10 and got(queries.op12_hard_negatives(spark, f"/root/testdata/{sf}")) == sorted(want)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.5], 0), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, 1), (3, [1.0, nan], 1), (4, [inf, 1.0], 1), (5, [], 1), (6, [1.0, 2.0, 3.0], 1), (7, [0.5, 0.5], 0), (8, [0.5, 0.5], 2), (8, [0.5, 0.5], 2)]
    rows += [(9, [0.5, 0.4], None), (None, [1.0, 1.0], 1), (10, [-1.0, 0.0], 3), (11, [1.0, 0.0], 3), (12, [-0.4, 0.0], 4), (20, [0.0, 0.0], 5), (21, [0.0, 0.0], 5), (22, [3.0, 3.0], 6), (30, [1.0, 2.0, 3.0], 2), (31, [1.0, 2.0, 2.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").union(spark.createDataFrame([(13, [None, 1.0], 1)], "vec_id long, embedding array<float>, label int")).withColumns({c: F.lit("x") for c in ("_id", "_cell", "_label", "_v")})
    mined = lambda d: negatives.mine(d, F.col("vec_id") % 10 == 0, F.col("label"))
    assert got(mined(df)) == brute(rows, 10)
    assert mined(df.limit(0)).count() == 0
    assert mined(df.filter("vec_id % 10 != 0")).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_groups_copies_and_labels(spark, monkeypatch, small):
    """Clusters, a vector that a third of all rows share, labels of one row each: the same rows with many groups and slices."""
    if small:
        for name, n in (("LEAF", 4), ("ANCHOR_LEAF", 2), ("SLICE", 50), ("GROUP", 8), ("CELL", 40)):
            monkeypatch.setattr(negatives, name, n)
    rng = np.random.default_rng(3)
    center = rng.normal(0, 1, (6, 9))
    rows = []
    for i in range(900):
        v = center[0] if i % 3 == 0 else center[i % 6] + rng.normal(0, 0.3, 9)
        rows.append((i, [float(np.float32(x)) for x in v], i if i % 50 == 1 else i % 4))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    out = negatives.mine(df, F.col("vec_id") % 20 == 0, F.col("label"), sample=120 if small else 4096)
    assert got(out) == brute(rows, 20)


def test_intervals_hold_all_products():
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (300, 5)).astype(float)
    t = negatives.Tree(v, rng.integers(0, 3, 300), 10)
    assert sorted(t.order.tolist()) == list(range(300))
    for n in range(len(t.start)):
        lo, hi = negatives.interval(t.center[n], t.norm[n], t.radius[n], t.center, t.norm, t.radius)
        for m in range(len(t.start)):
            s = v[t.order[t.start[n] : t.end[n]]] @ v[t.order[t.start[m] : t.end[m]]].T
            assert lo[m] <= s.min() and s.max() <= hi[m]


def test_whole_groups_are_pruned():
    """Far clusters: most pairs of rows are never scored."""
    rng = np.random.default_rng(2)
    center = np.eye(8) * 1000
    v = np.repeat(center, 400, 0) + rng.integers(-20, 20, (3200, 8))
    label, ids = np.arange(3200) % 2, np.arange(3200)
    a = np.arange(0, 3200, 10)
    seen = []
    whole = negatives.scored
    try:
        negatives.scored = lambda left, right, node, leaves, *more: (seen.append((left.end[node] - left.start[node]) * (right.end[leaves] - right.start[leaves]).sum()), whole(left, right, node, leaves, *more))
        w = negatives.Wanted(np.arange(len(a)), np.full(len(a), 500_000.0), np.full(len(a), np.inf), 5, True)
        negatives.search(ids[a], v[a].astype(float), label[a], ids, v.astype(float), label, w)
    finally:
        negatives.scored = whole
    assert all(len(x[0]) == 5 for x in w.found) and sum(seen) < 0.2 * len(a) * len(v)
