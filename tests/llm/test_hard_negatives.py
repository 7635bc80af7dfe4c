"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from conftest import SMALL

from hostwatch.llm import hard_negatives as H
from hostwatch.llm import queries

NAN, INF = float("nan"), float("inf")


def plain(rows, every=100, positives=5, negatives=10, low=30, high=90):
    fine = [(n, i, label, [math.floor(256 * x) for x in v]) for n, (i, v, label) in enumerate(rows)
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, label, v in fine:
        if i % every == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), j, other == label) for m, j, other, w in fine if m != n and len(v) == len(w)]
            for s, j, _ in sorted(r for r in scored if r[2])[:positives]:
                fits = sorted(r for r in scored if not r[2] and low * -s <= 100 * -r[0] <= high * -s)[:negatives]
                out += [(i, j, rank, m, -s, -t) for rank, (t, m, _) in enumerate(fits, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "", 1, "", 1) for r in rows], "vec_id long, embedding array<double>, label int, row string, x int, page string, rank int").repartition(3)


def mined(df, **kw):
    return sorted(map(tuple, H.mine(df, **kw).collect()))


def test_table(spark):
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in
            (tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect())]
    got = sorted(map(tuple, queries.op13_hard_negatives(spark, SMALL).collect()))
    assert got == plain(rows) and got


@pytest.mark.parametrize("sizes", [H.Sizes(), H.Sizes(run=60, page=16, leaf=4, block=2, regions=5, slab=3)])
def test_over_pages_blocks_and_regions(spark, sizes):
    rng = np.random.default_rng(3)
    rows = [(int(n), [float(x) for x in np.round(rng.normal(size=5) * rng.choice([0.2, 1, 3]) + (n % 3), 2)], int(n % 4)) for n in range(500)]
    rows += [(1000 + n, rows[7][1], 3 - n % 2) for n in range(60)] + [(2000 + n, [0.0] * 5, n) for n in range(3)]
    assert mined(table(spark, rows), every=25, sizes=sizes) == plain(rows, every=25)


def test_odd_rows(spark):
    rows = [(100, [1.0, 0.5], 0), (1, [1.0, 0.5], 0), (2, [0.5, 0.5], 1), (3, None, 0), (4, [1.0, NAN], 1), (5, [INF, 1.0], 1), (6, [1.0, None], 1), (None, [0.5, 0.5], 1), (7, [0.5, 0.25], None),
            (8, [0.5, 0.5], 1), (8, [0.5, 0.5], 1), (100, [1.0, 0.5], 0), (200, [0.5], 0), (9, [0.75], 0), (10, [0.5], 2), (300, [], 0), (11, [], 0), (12, [], 1), (400, [-1.0, 0.0], 5), (13, [1.0, 0.0], 5), (14, [0.6, 0.3], 0)]
    got = mined(table(spark, rows))
    assert got == plain(rows) and {r[0] for r in got} >= {100, 200, 300}
    assert mined(table(spark, [])) == [] and mined(table(spark, rows[2:4])) == []


def test_boxes_bound_products_and_tiles_are_small():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(300, 4)), rng.normal(size=(7, 4))
    parts = H.tiles(x, [2, 0], 32)
    assert sorted(np.concatenate(parts)) == list(range(300)) and max(map(len, parts)) <= 32
    for part in parts:
        low, high = H.intervals(q, x[part].min(axis=0)[None], x[part].max(axis=0)[None])
        scores = q @ x[part].T
        assert (scores >= low - 1e-9).all() and (scores <= high + 1e-9).all()
