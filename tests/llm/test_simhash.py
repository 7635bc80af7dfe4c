"""Fingerprints and links against brute force."""

import numpy as np
import xxhash
from conftest import SMALL

from hostwatch.llm import queries, simhash
from hostwatch.llm.common import components


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, most=4):
    fps = list(dict.fromkeys(fps))
    label = {f: f for f in fps}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f
    a = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= most):
            label[root(fps[i + 1 + j])] = root(f)
    return {f: root(f) for f in fps}


def expected(rows):
    fps = {}
    for n, (doc, text) in enumerate(rows):
        fps[n] = plain(text)
    of = groups(fps.values())
    least = {}
    for n, (doc, _) in enumerate(rows):
        if doc is not None:
            least[of[fps[n]]] = min(doc, least.get(of[fps[n]], doc))
    return sorted(((doc, f"{fps[n]:016x}", least.get(of[fps[n]])) for n, (doc, _) in enumerate(rows)), key=str)


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op2_simhash(spark, SMALL).collect()), key=str)
    assert got == expected(rows)
    assert any(r[0] != r[2] for r in got)


def test_odd(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(5, None), (3, ""), (9, " \t\x0b "), (1, "A b C d e"), (1, "A b C d e"), (2, "a B c D E"), (None, "a b c d e"), (7, "two words"), (8, "ÄA b"), (None, "lone text here now ok"), (4, long), (6, long + " x")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component string").repartition(3)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == expected(rows)
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_links_connect_what_brute_force_connects(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    fps = [int(c) for c in rng.integers(0, 2 ** 63, 1500, dtype=np.uint64)]
    for c in centres:
        for _ in range(30):
            bits = rng.choice(64, rng.integers(1, 7), replace=False)
            fps.append(int(c) ^ sum(1 << int(b) for b in bits))
    fps += [1 << b for b in range(64)] + [0, 2 ** 64 - 1]
    fps = list(dict.fromkeys(fps))
    want = groups(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for bucket, far in ((1024, 64), (8, 64), (8, 2)):
        monkeypatch.setattr(simhash, "FAR", far)
        links = simhash.links(df, 4, bucket)
        found = {r.node % 2 ** 64: r.component % 2 ** 64 for r in components(links).collect()}
        mine = {}
        for f in fps:
            mine.setdefault(found.get(f, f), set()).add(f)
        other = {}
        for f in fps:
            other.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, other.values()))


def test_index_prunes_nothing_near():
    rng = np.random.default_rng(8)
    fps = np.unique(np.r_[rng.integers(0, 2 ** 16, 600, dtype=np.uint64), rng.integers(0, 2 ** 63, 300, dtype=np.uint64)])
    keys = np.sort(rng.integers(0, 3, len(fps)))
    order = np.lexsort((simhash.gray_rank(fps), keys))
    sorted_fps, sorted_keys = fps[order], keys[order]
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    index = simhash.Index(sorted_fps, starts)
    i, j = index.links(sorted_fps, 0, len(fps), np.searchsorted(starts, np.arange(len(fps)), "right") - 1, 4)
    close = np.bitwise_count(sorted_fps[:, None] ^ sorted_fps[None]) <= 4
    same = sorted_keys[:, None] == sorted_keys[None]
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(np.triu(close & same, 1)))))


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 120)]
    star = [(1000, k) for k in range(1001, 1300)]
    ring = [(2000 + k, 2000 + (k + 1) % 37) for k in range(37)]
    edges = spark.createDataFrame(chain + star + ring + ring[:5] + [(7, 7), (None, 4)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 121)}, **{k: 1000 for k in range(1000, 1300)}, **{2000 + k: 2000 for k in range(37)}}
    assert components(edges.where("false")).count() == 0
