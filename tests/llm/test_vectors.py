"""Embedding groups and top-k search against brute force."""

import math

import numpy as np
import pytest
from conftest import SMALL

from hostwatch.llm import embeddings, queries, topk

NAN, INF = float("nan"), float("inf")


def groups(rows, cosine=0.98):
    fine = [(n, i, np.array(v, np.float64), label) for n, (i, v, label) in enumerate(rows)
            if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {}
    for n, i, v, label in fine:
        near[n] = [m for m, j, w, other in fine if m != n and other == label and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine]
    out = []
    for n, (i, _, _) in enumerate(rows):
        reach, todo = {n}, [n]
        while todo:
            todo = [m for k in todo for m in near.get(k, []) if m not in reach and not reach.add(m)]
        least = min((rows[m][0] for m in reach), default=i) if i is not None else None
        out.append((i, len(near.get(n, [])), least, i is not None and i == least))
    return sorted(out, key=str)


def test_group_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(map(tuple, queries.op3_embedding_dedup(spark, SMALL).collect()), key=str)
    assert got == groups(rows)


@pytest.mark.parametrize("block, per_cell", [(2048, 2048), (16, 20)])
def test_groups_over_cells_and_blocks(spark, block, per_cell):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(12, 16))
    rows = []
    for n in range(400):
        v = centres[n % 12] + rng.normal(size=16) * rng.choice([0.05, 0.1, 0.16, 0.5])
        rows.append((n, [float(x) for x in v], n % 2))
    rows += [(1000 + n, rows[5][1], 1) for n in range(30)] + [(2000, [2 * x for x in rows[5][1]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = sorted(map(tuple, embeddings.near_duplicates(df, per_cell=per_cell, block=block).collect()), key=str)
    assert got == groups(rows)


ODD = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [1.0, NAN], 0), (7, [INF, 1.0], 0), (8, [], 0), (9, [1.0, None], 0),
       (10, [1.0, 0.0, 0.0], 0), (11, [5.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (12, [1.0, 0.0], 1), (13, [1.0, 0.0], 0), (14, [1e300, 0.0], 0), (15, [1e-300, 0.0], 0)]
SCHEMA = "vec_id long, embedding array<double>, label int, id string, cell int, vector string, x int, q int, rank int"


def odd(spark, rows):
    return spark.createDataFrame([(*r, "", 1, "", 1, 1, 1) for r in rows], SCHEMA).repartition(3)


def test_odd_groups(spark):
    got = sorted(map(tuple, embeddings.near_duplicates(odd(spark, ODD)).collect()), key=str)
    with np.errstate(all="ignore"):
        want = groups([(i, [x * 1e-300 if x == 1e300 else x * 1e300 if x == 1e-300 else x for x in v] if v and None not in v else v, label) for i, v, label in ODD])
    assert got == want
    assert embeddings.near_duplicates(odd(spark, [])).count() == 0
    assert embeddings.near_duplicates(odd(spark, [r for r in ODD if r[1] is None])).collect()[0].n_links == 0


def nearest(rows, k, every, scale=256):
    fine, seen = [], set()
    for i, v in sorted(((i, v) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0], [math.floor(scale * x) for x in r[1]])):
        if i not in seen:
            seen.add(i)
            fine.append((i, [math.floor(scale * x) for x in v]))
    lengths = [len(v) for _, v in fine]
    dims = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    fine = [r for r in fine if len(r[1]) == dims]
    out = []
    for i, v in fine:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in fine if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, queries.op9_top_k(spark, SMALL).collect())) == nearest(rows, 5, 50)


@pytest.mark.parametrize("per_pivot, block", [(4096, 1024), (30, 8)])
def test_top_k_over_cells_and_blocks(spark, monkeypatch, per_pivot, block):
    monkeypatch.setattr(topk, "PER_PIVOT", per_pivot)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SLAB", 10)
    rng = np.random.default_rng(2)
    rows = [(int(n), [float(x) for x in np.round(rng.normal(size=6) * rng.choice([0.2, 1, 3]), 2)]) for n in range(500)]
    rows += [(1000 + n, rows[7][1]) for n in range(40)] + [(2000 + n, [0.0] * 6) for n in range(3)] + rows[:3]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(map(tuple, topk.top_k(df, every=7).collect())) == nearest(rows, 5, 7)


def test_odd_top_k(spark):
    small = [r for r in ODD if not r[1] or 1e300 not in r[1]]
    assert sorted(map(tuple, topk.top_k(odd(spark, small), every=1).collect())) == nearest(small, 5, 1)
    assert topk.top_k(odd(spark, [])).count() == 0
    assert topk.top_k(odd(spark, ODD[:1]), every=1).count() == 0


def test_large_numbers_stay_exact():
    q, x = np.array([[2 ** 30 + 1, 3]]), np.array([[2 ** 30 + 1, 1], [2 ** 30, 5]])
    assert topk._scores(q, x).tolist() == [[(2 ** 30 + 1) ** 2 + 3, (2 ** 30 + 1) * 2 ** 30 + 15]]
