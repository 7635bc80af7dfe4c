"""Toxicity by nearest labelled examples: exact TF-IDF cosine over an inverted index, weighted votes, calibrated.

Terms are words and their beginnings; those that go with the label in the training rows (chi-square) are the vocabulary.
Every document becomes a short vector of vocabulary terms.  Examples are training rows with such a vector; the index holds
their postings, those of frequent terms as rows of a dense matrix.  Queries are taken together: products in single precision and the
postings of rarer terms leave the few examples that can be neighbours, whose cosines are then summed up exactly.  Votes weighted by
distance are mapped to rates seen on the examples themselves, each scored without its own vote.
"""

from __future__ import annotations

import re
from collections import Counter
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostwatch.llm.common import stored

#: Examples in the index at most (a sample by hash beyond), terms of the vocabulary at most, neighbours.
EXAMPLES, TERMS, NEIGHBOURS = 20_000, 4096, 15
#: Least chi-square and least number of positive rows of a term.
CHI_SQUARE, LEAST = 40.0, 5
#: Beginnings of words that are terms, bins of the calibration, words a task counts before it passes counts on.
BEGINNINGS, BINS, COUNTED = (4, 5), 20, 400_000
#: Terms that are held as dense rows at most, the share of examples that makes a term one of them, queries that are taken together.
DENSE, FREQUENT, TOGETHER = 512, 0.01, 64
#: Every so manieth example gives a first limit; more than what single precision is off by, for cosines.
EVERY, ROUNDING = 16, 1e-4
THRESHOLD = 0.3

_WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def _distinct_words(batches):
    """Texts as their distinct words in order, which is what is shuffled to meet the labels."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(sorted(set(words_of(t.as_py())))) for t in batch.column(1)], pa.string())],
                                         names=["doc_id", "words"])


def _term_counts(batches):
    """Rows of each label that have a term: a word, or the beginning (marked by a sign in front) of a longer one."""
    counts: dict[str, list[int]] = {}

    def rows():
        t, c = list(counts), np.array(list(counts.values()), np.int64).reshape(-1, 2)
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(c[:, 0]), pa.array(c[:, 1])], names=["term", "pos", "neg"])

    for batch in batches:
        for words, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words.split()
            for term in (*words, *{"^" + w[:length] for length in BEGINNINGS for w in words if len(w) > length}):
                counts.setdefault(term, [0, 0])[1 - toxic] += 1
            if len(counts) > COUNTED:
                yield rows()
    if counts:
        yield rows()


def vocabulary(train: DataFrame, pos: int, neg: int, terms: int = TERMS) -> list[str]:
    """The terms that go with label 1, from all of ``train`` (words, toxic: ``pos`` rows of label 1 and
    ``neg`` of 0), the strongest ``terms`` at most."""
    if not pos or not neg:
        return []
    counts = train.select("words", "toxic").mapInArrow(_term_counts, "term string, pos long, neg long").groupBy("term").agg(
        F.sum("pos").cast("double").alias("a"), F.sum("neg").cast("double").alias("b"))
    a, b, c, d = F.col("a"), F.col("b"), F.lit(float(pos)) - F.col("a"), F.lit(float(neg)) - F.col("b")
    chi = F.try_divide((a * d - b * c) * (a * d - b * c) * (pos + neg), (a + b) * (c + d) * F.lit(float(pos)) * F.lit(float(neg)))
    fit = counts.where((F.col("a") >= LEAST) & (a * neg > b * pos)).withColumn("chi", chi).where(F.col("chi") >= CHI_SQUARE)
    return [r.term for r in fit.orderBy(F.desc("chi"), "term").limit(terms).select("term").collect()]


def vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``doc_id, terms (numbers), counts`` for every row of ``docs``."""
    places = {t: k for k, t in enumerate(terms) if t[0] != "^"}
    begins = [(n, {t[1:]: k for k, t in enumerate(terms) if t[0] == "^" and len(t) == n + 1}) for n in BEGINNINGS]

    def terms_of(word: str) -> list[int]:
        return ([places[word]] if word in places else []) + [known[word[:m]] for m, known in begins if len(word) > m and word[:m] in known]

    def run(batches):
        met: dict[str, list[int]] = {}
        for batch in batches:
            numbers, counts, ends = [], [], [0]
            for text in batch.column(1):
                own: dict[int, int] = {}
                if len(met) > COUNTED:
                    met.clear()
                for w, times in Counter(words_of(text.as_py())).items():
                    found = met.get(w)
                    if found is None:
                        found = met[w] = terms_of(w)
                    for k in found:
                        own[k] = own.get(k, 0) + times
                for k in sorted(own):
                    numbers.append(k)
                    counts.append(own[k])
                ends.append(len(numbers))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (numbers, counts))],
                                             names=["doc_id", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, terms array<int>, counts array<int>")


class Index:
    """Examples by term and terms by example; the terms that most examples have are rows of a dense matrix too."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray], toxic: np.ndarray, ids: np.ndarray, idf: np.ndarray):
        self.toxic, self.ids, self.idf, n = toxic, ids, idf, len(terms)
        sizes = np.array([len(t) for t in terms], np.int64)
        self.own = np.r_[0, np.cumsum(sizes)]  # where the terms of each example begin
        example = np.repeat(np.arange(n), sizes)
        term, weight = (np.concatenate(x) if n else np.zeros(0) for x in (terms, weights))
        self.term, self.own_weight = term.astype(np.int64), weight
        held = np.bincount(self.term, minlength=len(idf))
        frequent = np.argsort(-held, kind="stable")[:DENSE]
        frequent = frequent[held[frequent] > FREQUENT * n]
        self.row = np.full(len(idf), -1)  # of the dense matrix
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), n), np.float32)
        at = self.row[self.term]
        self.dense[at[at >= 0], example[at >= 0]] = weight[at >= 0]
        order = np.argsort(self.term, kind="stable")
        self.example, self.weight = example[order], weight[order]
        self.begin = np.r_[0, np.cumsum(held)]

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above zero, exactly; ties go to the earlier example."""
        return next(self.nearest_of([(terms, weights)], k, [without]))

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None):
        """:meth:`nearest` of every query (terms, weights)."""
        for first in range(0, len(queries), TOGETHER):
            some = queries[first:first + TOGETHER]
            wanted = np.zeros((len(some), len(self.dense)), np.float32)
            for q, (terms, weights) in enumerate(some):
                frequent = self.row[terms] >= 0
                wanted[q, self.row[terms[frequent]]] = weights[frequent]
            for q, (scores, (terms, weights)) in enumerate(zip(wanted @ self.dense, some)):
                self._add_rare(scores, terms, weights)
                yield self._best(scores, terms, weights, k, without[first + q] if without else -1)

    def _add_rare(self, scores: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """Add what the terms without a dense row give."""
        rare = (self.row[terms] < 0) & (self.begin[terms + 1] > self.begin[terms])
        parts = [(slice(self.begin[t], self.begin[t + 1]), w) for t, w in zip(terms[rare].tolist(), weights[rare].tolist())]
        if parts:
            scores += np.bincount(np.concatenate([self.example[at] for at, _ in parts]), np.concatenate([self.weight[at] * w for at, w in parts]), len(scores))

    def _best(self, scores: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest, given all cosines but for ROUNDING."""
        if without >= 0:
            scores[without] = 0
        few = scores[::EVERY]
        least = np.partition(few, -k)[-k] if len(few) >= k else 0.0
        hit = np.flatnonzero(scores >= least - ROUNDING) if least > ROUNDING else np.flatnonzero(scores)
        if len(hit) > k:
            hit = hit[scores[hit] >= np.partition(scores[hit], -k)[-k] - ROUNDING]
        value = self._cosines(hit, terms, weights)
        best = np.lexsort((hit, -value))[:k]
        best = best[value[best] > 0]
        return hit[best], value[best]

    def _cosines(self, examples: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Cosines of some examples in double precision, summed up in order of the terms."""
        query = np.zeros(len(self.idf))
        query[terms] = weights
        sizes = self.own[examples + 1] - self.own[examples]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.own[examples] - ends + sizes, sizes)
        return np.bincount(np.repeat(np.arange(len(examples)), sizes), query[self.term[place]] * self.own_weight[place], len(examples))

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        weight = 1 / (1.02 - np.minimum(cosine, 1))
        return float((weight * self.toxic[found]).sum() / weight.sum()) if len(found) else 0.0


def calibration(votes: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rates by vote that never fall: bins of equal numbers, neighbouring ones joined while their rates fall."""
    order = np.argsort(votes, kind="stable")
    bins = [[float(votes[b].mean()), float(toxic[b].sum()), float(len(b))] for b in np.array_split(order, min(BINS, len(order))) if len(b)]
    out: list[list[float]] = []
    for b in bins:
        out.append(b)
        while len(out) > 1 and out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2]:
            v, p, n = out.pop()
            out[-1] = [(out[-1][0] * out[-1][2] + v * n) / (out[-1][2] + n), out[-1][1] + p, out[-1][2] + n]
    return np.array([b[0] for b in out]), np.array([b[1] / b[2] for b in out])


_INDEXES: list[tuple] = []


def _index(shared, name: str) -> Index:
    """The index of this process for a broadcast, which is unpacked once for all tasks; ``name`` is that of the run."""
    if not _INDEXES or _INDEXES[0][0] != name:
        ids, terms, counts, toxic, idf = shared.value
        index = Index([], [], np.zeros(0), np.zeros(0), idf)
        index = Index(terms, [index.unit(t, c) for t, c in zip(terms, counts)], toxic, ids, idf)
        index.vectors = terms, counts
        _INDEXES[:] = [(name, index)]
    return _INDEXES[0][1]


def _rows_with(batches):
    """Rows of each term from rows (terms): one per term and task."""
    counts = np.zeros(0, np.int64)
    for batch in batches:
        here = np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(counts))
        here[:len(counts)] += counts
        counts = here
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["term", "n"])


def _own_votes(shared, name: str):
    """The vote on each example (column 0: its number) without its own."""
    def run(batches):
        for batch in batches:
            index = _index(shared, name)
            terms, counts = index.vectors
            numbers = batch.column(0).to_numpy().tolist()
            votes = [index.vote(*near) for near in index.nearest_of([(terms[k], index.unit(terms[k], counts[k])) for k in numbers], NEIGHBOURS, numbers)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64())], names=["k", "vote"])
    return run


_NEAR = "array<struct<doc_id: long, cosine: double, toxic: int>>"
_SCORED = f"terms array<int>, counts array<int>, score double, neighbours {_NEAR}"


def score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS) -> DataFrame:
    """``doc_id, held_out, score, predicted, neighbours`` for every row of ``docs`` (doc_id, text; more columns are ignored).

    Labels (doc_id, toxic 0/1) are learned from rows whose crc32(doc_id as text) mod 4 is not 2; a score depends on the text
    alone.  Texts without a vocabulary term, null and empty ones too, have the rate of such training rows.  ``neighbours`` are
    the nearest examples, the evidence.  A doc_id with several labels counts as toxic if one of them is 1; a null doc_id has no label and is not held out.
    Without both labels in training every score is the rate of label 1 (0 if there is none).
    """
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    known = stored(labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    training = docs.where("doc_id IS NOT NULL").where(~held).select("doc_id", "text").mapInArrow(_distinct_words, "doc_id long, words string")
    train = training.join(known.hint("merge"), "doc_id")  # one plan for every size
    rows = docs.select("doc_id").join(known, "doc_id").agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    words = vocabulary(train, rows[0], rows[1] - rows[0], terms)
    found = stored(vectors(docs, words))
    n = found.count()
    seen = {r.term: r.n for r in found.select("terms").mapInArrow(_rows_with, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row per vocabulary term
    idf = np.array([np.log((1 + n) / (1 + seen.get(k, 0))) + 1 for k in range(len(words))])
    mine = stored(found.join(known, "doc_id"))
    filled = F.size("terms") > 0
    rates = mine.agg(F.sum(F.when(~filled, F.col("toxic"))), F.count(F.when(~filled, 1)), F.count(F.when(filled, 1)), F.avg("toxic")).first()
    empty = (rates[0] or 0) / rates[1] if rates[1] else (rates[3] or 0.0)
    share = min(1.0, examples / rates[2]) if rates[2] else 0.0
    chosen = mine.where(filled & (F.pmod(F.xxhash64(F.lit("example"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))).orderBy("terms", "doc_id").toArrow()  # about ``examples`` rows
    columns = [np.array(chosen.column("doc_id"), np.int64), [np.array(t, np.int64) for t in chosen.column("terms").to_pylist()],
               [np.array(c, np.float64) for c in chosen.column("counts").to_pylist()], np.array(chosen.column("toxic"), np.int64)]
    shared, name, rates = spark.sparkContext.broadcast((*columns, idf)), uuid4().hex, None
    if chosen.num_rows:
        own = spark.range(0, chosen.num_rows, 1, max(1, chosen.num_rows // 500)).mapInArrow(_own_votes(shared, name), "k long, vote double").toArrow()  # a row per example
        rates = calibration(own.column("vote").to_numpy(), columns[3][own.column("k").to_numpy()])

    def answer(index: Index, hits: np.ndarray, cosine: np.ndarray) -> tuple[float, list]:
        if not len(hits):
            return float(empty), []
        near = [{"doc_id": int(index.ids[h]), "cosine": float(v), "toxic": int(index.toxic[h])} for h, v in zip(hits[:3], cosine)]
        return float(np.interp(index.vote(hits, cosine), *rates)), near

    def run(batches):
        kinds = pa.float64(), pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            found = [(float(empty), [])] * batch.num_rows
            if rates is not None:
                index = _index(shared, name)
                rows = [(np.array(t), np.array(c)) for t, c in zip(*(batch.column(k).to_pylist() for k in range(2)))]
                found = [answer(index, *near) for near in index.nearest_of([(t, index.unit(t, c)) for t, c in rows], NEIGHBOURS)]
            scores = [min(max(value, 0.0), 1.0) for value, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, kinds[0]), pa.array([near for _, near in found], kinds[1])],
                                             names=["terms", "counts", "score", "neighbours"])

    # equal vectors have equal scores, so each is searched once
    distinct = found.where(filled).select("terms", "counts").distinct().repartition("terms", "counts")
    scored = distinct.mapInArrow(run, _SCORED)
    out = found.where(filled).join(scored, ["terms", "counts"]).select("doc_id", "score", "neighbours").unionByName(
        found.where(~filled).select("doc_id", F.lit(min(max(float(empty), 0.0), 1.0)).alias("score"), F.array().cast(_NEAR).alias("neighbours")))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours")
