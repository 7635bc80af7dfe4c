"""The language model against a plain version, decisions against held-back labels, and the nearest examples against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
from conftest import SMALL

from hostwatch.llm import quality, queries, toxicity

MIDDLE, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def plain_model(texts):
    """Interpolated modified Kneser-Ney over dictionaries; returns the cost of an n-gram of classes."""
    order, base = quality.ORDER, [Counter()]
    for t in texts:
        s = [0] * (order - 1) + quality.symbols([t])[0].tolist()[order - 1:]
        base[0].update(tuple(s[i:i + order]) for i in range(len(s) - order + 1))
    counts = {order: base[0]}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    details = {}
    for n, c in counts.items():
        of = Counter(c.values())
        d = quality.discounts(*[of[k] for k in (1, 2, 3, 4)])
        total, taken = Counter(), Counter()
        for g, k in c.items():
            total[g[:-1]] += k
            taken[g[:-1]] += d[min(k, 3) - 1]
        details[n] = d, total, taken

    def p(g):
        if not g:
            return 1 / quality.CLASSES
        d, total, taken = details[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        k = counts[len(g)][g]
        return ((k - d[min(k, 3) - 1] if k else 0) + taken[g[:-1]] * p(g[1:])) / total[g[:-1]]
    return lambda g: -math.log(p(g))


def test_model_is_kneser_ney(spark):
    texts = ["the cat sat on the mat", "The dog!! sat", "", "été à la mode | x", "the the the cat 99"]
    model = quality.Model(quality.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)))
    cost = plain_model(texts)
    for t in [*texts, "zebra ~~ QQ", "x"]:
        s = quality.symbols([t])[0].tolist()
        want = sum(cost(tuple(s[i:i + quality.ORDER])) for i in range(len(t)))
        got, n = model.score([t])
        assert n[0] == len(t) and abs(got[0] - want) < 1e-3 * max(1, want)
    p = np.exp(-model.cost.reshape(-1, quality.CLASSES).astype(np.float64)).sum(axis=1)
    assert np.allclose(p, 1, atol=1e-4)


def test_quality_finds_labelled_junk(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.classify(docs, labels.where("doc_id % 3 > 0")).collect()}
    assert len(rows) == docs.count()
    held = [(rows[r.doc_id].keep, r.quality) for r in labels.where("doc_id % 3 = 0").collect() if r.doc_id in rows]
    assert np.mean([k for k, q in held if q == 1]) > 0.97
    assert np.mean([not k for k, q in held if q == 0]) > 0.9
    kept = quality.keep_good(docs, labels.where("doc_id % 3 > 0"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, r in rows.items() if r.keep}


def test_quality_rejects_repetition_and_cuts_at_unseen_quantiles(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    loops = [(-1 - k, w, l) for k, (w, l) in enumerate((w * 900, l) for w, l in (("Der ", "de"), ("The ", "en"), ("For ", "fr"), ("De ", "es")))]
    more = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(loops, "doc_id long, text string, lang string"))
    rows = {r.doc_id: r for r in quality.classify(more, labels.where("doc_id % 3 > 0")).collect()}
    assert not any(rows[d].keep for d, _, _ in loops)
    held = [(rows[r.doc_id].keep, r.quality) for r in labels.where("doc_id % 3 = 0").collect() if r.doc_id in rows]
    assert np.mean([k for k, q in held if q == 1]) > 0.97 and np.mean([not k for k, q in held if q == 0]) > 0.95


def plain_costs(texts):
    """Interpolated modified Kneser-Ney over n-grams of whole characters; returns the cost of an n-gram."""
    order, base = quality.ORDER, Counter()
    for t in texts:
        s = "\0" * (order - 1) + t
        base.update(s[i:i + order] for i in range(len(t)))
    counts = {order: base}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    of = {n: Counter(c.values()) for n, c in counts.items()}
    d = {n: quality.discounts(*[of[n][k] for k in (1, 2, 3, 4)]) for n in counts}

    def p(g):
        if not g:
            return 1 / 0x110000
        n = len(g)
        seen = {h: k for h, k in counts[n].items() if h[:-1] == g[:-1]}
        if not seen:
            return p(g[1:])
        off = {h: d[n][min(k, 3) - 1] for h, k in seen.items()}
        return (seen.get(g, 0) - off.get(g, 0) + sum(off.values()) * p(g[1:])) / sum(seen.values())
    return lambda g: -math.log(p(g))


def test_costs_are_kneser_ney_over_whole_characters(spark, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 100)  # several blocks
    texts = ["the cat sat on the mat " * 3, "The dog!! sat 17 times", "", "été à la mode | x\0y", "中文文本很好中文文本", "the the the cat 99", None, "😀 zebra 중 ~~ QQ 42", "x"] * 3
    docs = spark.createDataFrame([(n, t, "en") for n, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    good = docs.where("doc_id % 9 < 6").select("doc_id")
    fold = (docs.doc_id % 2).cast("long")
    rows = {r.doc_id: r for r in quality._raw(docs, good, fold).collect()}
    models = [plain_costs([t for n, t in enumerate(texts) if n % 9 < 6 and t and (m == 2 or n % 2 != m)]) for m in range(3)]
    assert len(rows) == len(texts)
    for n, t in enumerate(texts):
        s = "\0" * (quality.ORDER - 1) + (t or "")
        grams = [s[i:i + quality.ORDER] for i in range(len(t or ""))]
        assert rows[n].symbols == len(grams)
        for got, m in ((rows[n].total, 2), (rows[n].unseen, n % 2)):
            assert abs(got - sum(map(models[m], grams))) < 1e-3 * max(1, len(grams))


def test_characters_of_any_script_are_told_apart(spark):
    """Characters above U+3000, digits and capitals shared classes, so that texts of other characters cost the same."""
    usual, other = "今天天气很好我们去公园散步", "龘靐齉齾爩麤灪龗籱吁驫鱻癵"
    docs = [(n, usual * 5, "zh") for n in range(40)] + [(100, usual * 4, "zh"), (101, other * 4, "zh")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(n, 1) for n in range(40)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert rows[100].keep and not rows[101].keep and rows[101].perplexity > 10 * rows[100].perplexity


ODD = [(1, "fine text of the usual kind", "en"), (2, None, "en"), (3, "", None), (4, "x" * 500_000 + " end", "de"), (None, "fine text", "en"), (5, "fine text of the usual kind", None), (5, "fine text of the usual kind", None), (6, "😀😀 中文", "zz")]
SCHEMA = "doc_id long, text string, lang string, cost double, mean double, limit double, total double, terms string, toxic int, score double"


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1.0, 1.0, 1.0, 1.0, "", 1, 1.0) for r in ODD], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 0, "x"), (None, 1, 1, "x"), (5, None, None, "x"), (99, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(ODD) and all(r.keep for r in rows if r.doc_id in (2, 3))
    assert quality.keep_good(docs, labels).count() == sum(r.keep for r in rows)
    none = labels.where("false")
    assert quality.classify(docs, none).where("keep").count() == len(ODD) and quality.classify(docs.where("false"), labels).count() == 0
    assert quality.keep_good(docs.where("false"), labels).count() == 0
    for given in (labels, none):
        scores = toxicity.score(docs, given).collect()
        assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score(docs.where("false"), labels).count() == 0


def test_toxicity_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in queries.op7_toxicity(spark, LARGE).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.toxic) for r in labels.collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    assert np.mean([p == t for p, t in held]) > 0.95  # a few labels in a hundred contradict the texts
    assert sum(p and t for p, t in held) >= 0.8 * sum(t for _, t in held)
    assert any(r.neighbours for r in rows.values())


def test_equal_texts_have_equal_scores(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "text", "'zz' AS lang", "'other' AS source", "0 AS n_chars"))
    scores = {r.doc_id: r.score for r in toxicity.score(twice, labels).collect()}
    assert all(scores[d] == scores[d + 100000] for d in scores if d < 100000)


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    idf = rng.uniform(1, 8, 60)
    terms = [np.unique(rng.zipf(1.6, rng.integers(1, 9)) % 60) for _ in range(1000)]
    blank = toxicity.Index([], [], np.zeros(0), np.zeros(0), idf)
    weights = [blank.unit(t, rng.integers(1, 4, len(t)).astype(float)) for t in terms]
    index = toxicity.Index(terms, weights, rng.integers(0, 2, 1000), np.arange(1000), idf)
    dense = np.zeros((1000, 60))
    for k, (t, w) in enumerate(zip(terms, weights)):
        dense[k, t] = w
    for q in range(0, 1000, 17):
        found, cosine = index.nearest(terms[q], weights[q], 15, q)
        want = dense @ dense[q]
        want[q] = 0
        best = np.lexsort((np.arange(1000), -np.round(want, 12)))[:15]
        assert np.allclose(cosine, want[best][want[best] > 0]) and np.allclose(want[found], cosine)


def test_nearest_of_many_is_exact(monkeypatch):
    """Queries in batches, with and without dense rows, give what the plain sum over terms gives, ties by the earlier example."""
    rng = np.random.default_rng(3)
    idf = rng.uniform(1, 8, 300)
    terms = [np.unique(rng.zipf(1.3, rng.integers(1, 40)) % 300) for _ in range(700)] * 2  # every example twice
    blank = toxicity.Index([], [], np.zeros(0), np.zeros(0), idf)
    weights = [blank.unit(t, np.ones(len(t))) for t in terms]
    dense = np.zeros((1400, 300))
    for k, (t, w) in enumerate(zip(terms, weights)):
        dense[k, t] = w
    numbers = list(range(0, 1400, 9))
    for rows in (toxicity.DENSE, 0, 20):
        monkeypatch.setattr(toxicity, "DENSE", rows)
        index = toxicity.Index(terms, weights, np.zeros(1400, int), np.arange(1400), idf)
        for q, (found, cosine) in zip(numbers, index.nearest_of([(terms[n], weights[n]) for n in numbers], 15, numbers), strict=True):
            want = dense @ dense[q]
            want[q] = 0
            best = np.lexsort((np.arange(1400), -np.round(want, 12)))[:15]
            best = best[want[best] > 0]
            assert found.tolist() == best.tolist() and np.allclose(cosine, want[best], atol=1e-12, rtol=0)


def test_terms_are_counted_by_task(spark):
    """A task passes on a row per term, not one per document and term."""
    rows = spark.createDataFrame([([1, 2, 5],)] * 300 + [([2],)] * 100 + [([],)], "terms array<int>").repartition(3).mapInArrow(toxicity._rows_with, "term long, n long").collect()
    assert len(rows) <= 9 and {t: sum(r.n for r in rows if r.term == t) for t in (1, 2, 5)} == {1: 300, 2: 400, 5: 300}


def test_calibration_never_falls():
    rng = np.random.default_rng(4)
    votes = rng.uniform(size=500)
    x, y = toxicity.calibration(votes, (rng.uniform(size=500) < votes).astype(int))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all()
