"""Near-duplicates by word shingles against all pairs."""

import corpus_pipeline as pipeline
import numpy as np
import pyarrow as pa
from conftest import SMALL

from hostwatch.llm import shingles


def jaccard(a, b):
    a, b = ({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} for w in ((t or "").lower().split() for t in (a, b)))
    return len(a & b) / len(a | b)


def groups(texts):
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and jaccard(texts[i], texts[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    return label


def edited(rng, words, changes):
    out = list(words)
    for k in rng.choice(len(out), changes, replace=False):
        out[k] = f"n{rng.integers(1e9)}"
    return " ".join(out)


def test_near_copies_leave_and_others_stay(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(12):
        words = [f"w{k}" for k in rng.integers(0, 400, 200)]
        texts += [" ".join(words), *(edited(rng, words, c) for c in (2, 3, 4, 6, 9, 30))]
    docs = spark.createDataFrame([(n, t, "en", "a", len(t)) for n, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    of = groups(texts)
    want = {min(n for n, g in enumerate(of) if g == x) for x in of}
    assert 12 < len(want) < len(texts)
    for group in (1024, 3):
        monkeypatch.setattr(shingles, "GROUP", group)
        assert {r.doc_id for r in pipeline.one_of_each(spark, docs, "").collect()} == want


def test_table_and_odd_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-5, None), (-4, ""), (-3, "two words"), (-2, "Two  words"), (None, "two words"), (None, "lone text"), (-1, "😀 \t")]
    got = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    of = groups([t for _, t in rows])
    least = {}
    for (doc, _), g in zip(rows, of):
        least[g] = min((x for x in (doc, least.get(g)) if x is not None), default=None)
    assert sorted(map(tuple, got), key=str) == sorted(((doc, least[g]) for (doc, _), g in zip(rows, of)), key=str)


def test_fingerprints_propose_and_similarity_decides(spark, monkeypatch):
    """The stage goes through SimHash: without any band, what fingerprints link is found, and unlike texts of one fingerprint stay."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 400, 2000)]
    whole = " ".join(words)
    near = next(t for t in (edited(rng, words, c) for c in range(3, 40)) if 0 < (shingles.simhash.fingerprint(whole, 5) ^ shingles.simhash.fingerprint(t, 5)).bit_count() <= 4)
    assert jaccard(whole, near) >= 0.8
    texts = [whole, near, " ".join(f"v{k}" for k in rng.integers(0, 400, 2000)), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    marked = shingles._marked

    def without_bands(batches):
        for batch in marked(batches):
            own = pa.array([[n] if b else [] for n, b in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())], pa.list_(pa.int64()))
            fps = pa.array([0] * batch.num_rows, pa.int64()) if one else batch.column(3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], fps, own], names=batch.schema.names)

    monkeypatch.setattr(shingles, "_marked", without_bands)
    for one in (False, True):  # no text shares a bucket; then all texts have one fingerprint
        got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()}
        assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}
