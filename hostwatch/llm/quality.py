"""Quality by perplexity: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

N-grams are of whole characters, of any script, so the tables grow with the text and are never held in one place.  Documents are dealt
into blocks by their id.  A block gives its distinct n-grams, with their counts in its trusted documents; these are summed up by shards of
n-grams and joined with the totals of their contexts, order by order.  The finished costs are joined with the blocks' n-grams and go back
to the blocks, where every n-gram of every document is looked up.  Texts go to their blocks twice, packed in compressed batches.
A document is rejected when its perplexity is above a quantile of what its language's trusted documents show to a model that
has not seen them: trusted text is dealt into folds, and each fold is scored by a model of the others.  Repetition makes text
easy to foresee, so the share of words that repeat the one before has a limit of its own.

:class:`Model` and :func:`train` are a model of bounded size for text that fits no cluster: its characters fall into 64 classes.
:func:`judge` does not use them.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwatch.llm.common import cut, stored

ORDER, CLASSES = 4, 64
#: Signs with a class of their own; other characters share classes.
SIGNS = ".,!?:;'\"-|*#$%&"
#: The quantile of a language's trusted documents up to which documents are kept, and the folds that give it.
QUANTILE, FOLDS = 0.99, 2
#: Symbols of average text, and words that repeat nothing, that are added to every document, so that a few do not decide.
PRIOR, WORDS = 50, 10
#: Shares of repeated words that are kept in any language: few trusted documents show too little of what is usual.
USUAL = 0.1
#: Languages up to this number are sent to all tasks, more are joined.
LANGUAGES = 10_000
#: Symbols that are looked at together.
CHUNK = 1 << 21
#: Characters of a block of documents, and blocks that smaller input is dealt into if they get CHUNK characters each.
BLOCK, SPREAD = 1 << 25, 16
#: Bytes of rows that are packed together.
HELD = 1 << 25
#: Code points there are: what a model without any text expects.
CHARACTERS = 0x110000


def _class_of(code: int) -> int:
    c = chr(code)
    if "a" <= c <= "z":
        return code - 96
    if c in SIGNS:
        return 33 + SIGNS.index(c)
    if c in " \n":
        return 30 + (c == "\n")
    if c.isspace():
        return 32
    if c.isdigit():
        return 29
    if c.isupper():
        return 27 if code < 128 else 28
    if code < 128:
        return 48
    if code < 0x250 and c.isalpha():
        return 49 + code % 8
    return 57 + code % 6 if c.isalpha() else 63


_TABLE: list[np.ndarray] = []


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts, each behind ``ORDER - 1`` zeros, and where each text begins."""
    if not _TABLE:
        _TABLE.append(np.array([_class_of(c) for c in range(0x3000)] + [63], np.uint8))
    pad = "\0" * (ORDER - 1)
    codes = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[0][np.minimum(codes, 0x3000)]
    lengths = np.array([len(t) + ORDER - 1 for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    for k in range(ORDER - 1):
        out[starts + k] = 0
    return out, starts


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-grams of all texts, one per character, and how many each text has."""
    s, starts = symbols(texts)
    codes = s.astype(np.int32)
    out = codes.copy()
    for k in range(1, ORDER):
        out[k:] += codes[:-k] << (6 * k)
    real = np.ones(len(s), bool)
    for k in range(ORDER - 1):
        real[starts + k] = False
    return out[real], np.diff(np.r_[starts, len(s)]) - (ORDER - 1)


def _groups(texts):
    """Texts of a column in lists of about CHUNK characters; null texts are empty."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count(batches):
    """Counts of n-grams by fold from rows (text, fold)."""
    held = {}
    for batch in batches:
        folds = batch.column(1).to_numpy()
        for fold in np.unique(folds).tolist():
            for texts in _groups(batch.column(0).filter(pa.array(folds == fold))):
                codes, counts = held.get(fold, (np.zeros(0, np.int32), np.zeros(0, np.int64)))
                new, n = np.unique(ngrams(texts)[0], return_counts=True)
                codes, at = np.unique(np.r_[codes, new], return_inverse=True)
                held[fold] = codes, np.bincount(at, np.r_[counts, n], len(codes)).astype(np.int64)
    for fold, (codes, counts) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), fold, np.int64)), pa.array(codes.astype(np.int64)), pa.array(counts)], names=["fold", "code", "n"])


class Model:
    """Probabilities of all n-grams, from what each order's seen n-grams and contexts give."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        p = np.full(CLASSES, 1.0 / CLASSES, np.float32)
        for order, (codes, own, contexts, weight) in enumerate(orders, 1):
            g = np.ones(CLASSES ** (order - 1), np.float32)
            g[contexts] = weight
            p = (g.reshape(-1, CLASSES ** max(order - 2, 0))[:, :, None] * p.reshape(1, -1, CLASSES) if order > 1 else g[:, None] * p[None]).reshape(-1)
            p[codes] += own.astype(np.float32)
        self.cost = np.negative(np.log(p, out=p), out=p)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of costs and number of symbols of each text."""
        codes, counts = ngrams(texts)
        sums = np.r_[0.0, np.cumsum(self.cost[codes], dtype=np.float64)]
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts], counts


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """Discounts of n-grams seen once, twice and more often; where the counts of counts don't give any, a half of each step."""
    if not (ones and twos and threes):
        return 0.5, 1.0, 1.5
    y = ones / (ones + 2 * twos)
    found = 1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes
    return tuple(min(max(d, 0.1), k) for d, k in zip(found, (0.9, 1.9, 2.9)))


def count(trusted: DataFrame, fold=None) -> DataFrame:
    """``fold, code, n`` of all n-grams of ``trusted`` (text); ``fold`` is that of a row, or 0."""
    rows = trusted.select("text", (F.lit(0) if fold is None else fold).cast("long").alias("fold"))
    return cut(rows.mapInArrow(_count, "fold long, code long, n long").groupBy("fold", "code").agg(F.sum("n").alias("n")))


def train(trusted: DataFrame) -> list[tuple[np.ndarray, ...]]:
    """The model's tables from all of ``trusted`` (text)."""
    return tables(count(trusted))


def tables(counted: DataFrame) -> list[tuple[np.ndarray, ...]]:
    """The model's tables from counts (code, n): per order the seen n-grams with their own part of the
    probability, and the contexts with the weight of the order below.  At most CLASSES ** ORDER rows reach the driver."""
    counts = cut(counted.groupBy("code").agg(F.sum("n").alias("n")))
    below = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # lower orders count in how many contexts an n-gram continues
        below[order] = cut(below[order + 1].groupBy((F.col("code") % CLASSES ** order).alias("code")).agg(F.count("*").alias("n")))
    orders = []
    for order in range(1, ORDER + 1):
        c = below[order].withColumn("context", F.floor(F.col("code") / CLASSES).cast("long"))
        few = c.agg(*[F.coalesce(F.sum((F.col("n") == k).cast("long")), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        d1, d2, d3 = discounts(*few)
        taken = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = c.groupBy("context").agg(F.sum("n").alias("total"), F.sum(taken).alias("taken"))
        joined = c.join(context, "context").select("code", ((F.col("n") - taken) / F.col("total")).alias("own")).toArrow()
        weights = context.select("context", (F.col("taken") / F.col("total")).alias("weight")).toArrow()
        orders.append((*(joined.column(x).to_numpy() for x in ("code", "own")), *(weights.column(x).to_numpy() for x in ("context", "weight"))))
    return orders


def _grams(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct n-grams of whole characters, the place of each character's n-gram among them, and how many characters each text has."""
    pad = "\0" * (ORDER - 1)
    points = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + ORDER - 1) - lengths - ORDER + 1
    real = np.ones(len(points), bool)
    for k in range(ORDER - 1):
        real[starts + k] = False
    seen = np.zeros(CHARACTERS, bool)
    seen[points] = True
    signs = np.flatnonzero(seen)
    if len(signs) <= 1 << 16:
        rank = np.zeros(CHARACTERS, np.uint64)
        rank[signs] = np.arange(len(signs))
        ranks = rank[points]
        codes = ranks.copy()
        for k in range(1, ORDER):
            codes[k:] |= ranks[:-k] << np.uint64(16 * k)
        codes, place = np.unique(codes[real], return_inverse=True)
        found = signs.astype(np.uint32)[codes.astype("<u8").view("<u2").reshape(-1, 4)[:, ::-1]] if len(signs) else np.zeros((0, ORDER), np.uint32)
    else:
        ends = np.flatnonzero(real)
        found, place = np.unique(points[ends[:, None] - np.arange(ORDER - 1, -1, -1)], axis=0, return_inverse=True)
    joined = np.ascontiguousarray(found).tobytes().decode("utf-32-le")
    return pa.array([joined[at:at + ORDER] for at in range(0, len(joined), ORDER)], pa.string()), place.ravel(), lengths


_COUNTS = [f"n{k}" for k in range(FOLDS)]
#: Costs by the models that have not seen a fold, and by the one of all trusted text.
_COSTS = [f"cost{k}" for k in range(FOLDS + 1)]
_SCORES = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("content", pa.int64()), ("symbols", pa.int64()), ("total", pa.float64()), ("unseen", pa.float64()), ("repeats", pa.float64())])


def _packed(batches):
    """Rows (block, ..) as ``block, rows``: those of a block in compressed batches."""
    def done(t: pa.Table):
        for number in pc.unique(t["block"]).to_pylist():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
                out.write_table(t.filter(pc.equal(t["block"], number)).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD:
            yield from done(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield from done(pa.Table.from_batches(held))


def _unpacked(packed: pa.Table):
    """The tables of rows of a block, with their texts in lists: ``table, first row, texts``."""
    for rows in packed["rows"]:
        t, at = pa.ipc.open_stream(rows.as_buffer()).read_all(), 0
        for texts in _groups(t["text"]):
            yield t.slice(at, len(texts)), texts
            at += len(texts)


def _counted(block: pa.Table, good: pa.Table) -> pa.Table:
    """``block, gram`` and counts by fold in trusted documents, of all n-grams of a block of documents."""
    ids, parts = good["doc_id"].combine_chunks(), []
    whole = pa.table([pa.array([], t) for t in (pa.string(), *[pa.int64()] * FOLDS)], names=["gram", *_COUNTS])
    for rows, texts in _unpacked(block):
        trusted = pc.is_in(rows["doc_id"], value_set=ids).to_numpy().astype(bool)
        grams, place, n = _grams(texts)
        of = np.repeat(np.where(trusted, rows["fold"].to_numpy(), FOLDS), n)
        counts = np.bincount(of * len(grams) + place, minlength=(FOLDS + 1) * len(grams)).reshape(FOLDS + 1, -1)
        parts = [whole, pa.table([grams, *(pa.array(counts[k].astype(np.int64)) for k in range(FOLDS))], names=["gram", *_COUNTS])]
        whole = pa.concat_tables(parts).group_by("gram").aggregate([(c, "sum") for c in _COUNTS]).rename_columns(["gram", *_COUNTS])
    number = pa.array(np.full(len(whole), block["block"][0].as_py() if len(block) else 0, np.int64))
    return pa.table([number, *whole.columns], names=["block", *whole.column_names])


def _scored(block: pa.Table, costs: pa.Table) -> pa.Table:
    """A block's documents with their symbols, costs by both models and share of repeated words."""
    known, values, parts = costs["gram"].combine_chunks(), np.stack([costs[c].to_numpy() for c in _COSTS]), []
    for rows, texts in _unpacked(block):
        grams, place, n = _grams(texts)
        own = values[:, pc.index_in(grams, value_set=known).to_numpy()]
        ends, found = np.cumsum(n), []
        for cost in (own[FOLDS, place], own[np.repeat(rows["fold"].to_numpy(), n), place]):
            sums = np.r_[0.0, np.cumsum(cost, dtype=np.float64)]
            found.append(pa.array(sums[ends] - sums[ends - n]))
        parts.append(pa.table([*(rows[c] for c in ("doc_id", "lang", "content")), pa.array(n), *found, pa.array(_repeats(rows["text"]))], names=_SCORES.names))
    return pa.concat_tables([_SCORES.empty_table(), *parts])


def _discount(few: list[Column]) -> list[Column]:
    """:func:`discounts` over columns."""
    ones, twos, threes, fours = few
    y = ones / (ones + 2 * twos)
    found = 1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes
    some = (ones > 0) & (twos > 0) & (threes > 0)
    return [F.when(some, F.least(F.greatest(d, F.lit(0.1)), F.lit(k))).otherwise(F.lit(half)) for d, k, half in zip(found, (0.9, 1.9, 2.9), (0.5, 1.0, 1.5))]


def gram_costs(counted: DataFrame) -> DataFrame:
    """``gram, cost0 .. cost{FOLDS}`` for every n-gram of ``counted`` (gram, n0 .. by fold; rows of an n-gram are summed up).

    ``cost{k}`` is by the model of all folds but ``k``, the last one by that of all folds.  Characters no model has seen share what is left for all code points.
    """
    models = range(FOLDS + 1)
    every = sum((F.sum(c) for c in _COUNTS), F.lit(0))
    below = {ORDER: cut(counted.groupBy("gram").agg(*[(every - F.sum(c)).alias(f"m{j}") for j, c in enumerate(_COUNTS)], every.alias(f"m{FOLDS}")))}
    for order in range(ORDER - 1, 0, -1):  # lower orders count in how many contexts an n-gram continues
        below[order] = below[order + 1].groupBy(F.substring("gram", 2, order).alias("gram")).agg(*[F.sum((F.col(f"m{j}") > 0).cast("long")).alias(f"m{j}") for j in models])
    lower = None
    for order in range(1, ORDER + 1):
        few = below[order].agg(*[F.sum((F.col(f"m{j}") == k).cast("long")).alias(f"f{j}{k}") for j in models for k in (1, 2, 3, 4)])
        few = few.select(*[d.alias(f"d{j}{k}") for j in models for k, d in enumerate(_discount([F.col(f"f{j}{n}") for n in (1, 2, 3, 4)]), 1)])
        rows = below[order].crossJoin(F.broadcast(few)).withColumn("context", F.substring("gram", 1, order - 1))
        rows = rows.select("gram", "context", *[f"m{j}" for j in models], *[
            F.when(F.col(f"m{j}") == 0, 0.0).when(F.col(f"m{j}") == 1, F.col(f"d{j}1")).when(F.col(f"m{j}") == 2, F.col(f"d{j}2")).otherwise(F.col(f"d{j}3")).alias(f"t{j}") for j in models])
        context = rows.groupBy("context").agg(*[F.sum(f"m{j}").alias(f"s{j}") for j in models], *[F.sum(f"t{j}").alias(f"w{j}") for j in models])
        rows = rows.join(context, "context")
        if lower is None:
            rows = rows.select("*", *[F.lit(1.0 / CHARACTERS).alias(f"p{j}") for j in models])
        else:
            rows = rows.withColumn("suffix", F.substring("gram", 2, order - 1)).join(lower.withColumnRenamed("gram", "suffix"), "suffix")
        p = [F.when(F.col(f"s{j}") > 0, (F.col(f"m{j}") - F.col(f"t{j}") + F.col(f"w{j}") * F.col(f"p{j}")) / F.col(f"s{j}")).otherwise(F.col(f"p{j}")) for j in models]
        lower = rows.select("gram", *[x.alias(f"p{j}") for j, x in zip(models, p)])
    return lower.select("gram", *[(-F.log(f"p{j}")).cast("float").alias(c) for j, c in zip(models, _COSTS)])


def _raw(docs: DataFrame, good: DataFrame, fold: Column) -> DataFrame:
    """``doc_id, lang, content, symbols, total, unseen, repeats`` for every row of ``docs``; trusted are those with an id of ``good``.

    Rows of one ``doc_id`` are in one block, those without one are dealt by their text.
    """
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK), min(SPREAD, -(-size // CHUNK)))
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
    block = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(blocks))).otherwise(dealt).alias("block")
    rows = docs.select(block, "doc_id", "lang", "text", F.xxhash64("text").alias("content"), fold.cast("long").alias("fold"))
    texts, plain = (x.mapInArrow(_packed, "block long, rows binary").groupBy("block") for x in (rows, rows.select("block", "doc_id", "text", "fold")))
    columns = "block long, gram string, " + ", ".join(f"{c} long" for c in _COUNTS)
    counted = stored(plain.cogroup(good.select(dealt, "doc_id").groupBy("block")).applyInArrow(_counted, columns))
    wanted = counted.select("block", "gram").join(gram_costs(counted), "gram")
    return cut(texts.cogroup(wanted.groupBy("block")).applyInArrow(_scored, "doc_id long, lang string, content long, symbols long, total double, unseen double, repeats double"))


def _repeats(texts) -> np.ndarray:
    """The share of words of each text that repeat the word before."""
    out = np.zeros(len(texts))
    for k, t in enumerate(texts):
        words = (t.as_py() or "").split()
        out[k] = sum(map(eq, words, words[1:])) / (len(words) + WORDS)
    return out


def _sent(by_lang: DataFrame) -> DataFrame:
    """A table with a row per language: sent to all tasks up to LANGUAGES rows, so that a hot language stays spread."""
    return F.broadcast(by_lang) if by_lang.count() <= LANGUAGES else by_lang


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE):
    """Train on the trusted of ``docs`` and find the limits.  Returns ``(scores, limits)``.

    Trusted are rows whose ``doc_id`` has a row of ``labels`` with quality 1.  ``scores``: doc_id, lang, content (a hash of the text), symbols, repeats, cost (a document's mean
    cost per symbol with PRIOR symbols of its language's trusted mean added).  ``limits``: lang, mean, limit, the quantile of costs by
    the models that have not seen the document, most, the quantile of shares of repeated words
    or USUAL if that is higher.
    A language without trusted documents, null too, has the limit of all trusted documents together.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().hint("merge")  # one plan for every size
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS))
    raw = _raw(docs, good, fold)
    trusted = cut(raw.join(good, "doc_id", "left_semi"))
    overall = trusted.agg(F.sum("unseen") / F.sum("symbols")).first()[0] or 0.0
    means = trusted.groupBy("lang").agg((F.sum("unseen") / F.sum("symbols")).alias("mean"))
    languages = raw.select("lang").distinct()
    means = cut(languages.alias("l").join(means.alias("m"), F.col("l.lang").eqNullSafe(F.col("m.lang")), "left")
                .select("l.lang", F.coalesce("m.mean", F.lit(overall)).alias("mean")))
    sent = _sent(means)

    def smoothed(rows, total="total"):
        smooth = (F.col(total) + PRIOR * F.col("mean")) / (F.col("symbols") + PRIOR)
        return rows.alias("r").join(sent.alias("m"), F.col("r.lang").eqNullSafe(F.col("m.lang"))).select("r.*", "m.mean").withColumn("cost", smooth)

    # what equals a quantile but for rounding is kept
    limit, most = ((F.percentile_approx(c, F.lit(quantile), 10_000) + 1e-9).alias(name) for c, name in (("cost", "limit"), ("repeats", "most")))
    costs = smoothed(trusted, "unseen")
    every = [float("inf") if x is None else x for x in costs.agg(limit, most).first()]
    own = costs.groupBy("lang").agg(limit, most)
    limits = cut(means.alias("m").join(own.alias("o"), F.col("m.lang").eqNullSafe(F.col("o.lang")), "left")
                 .select("m.lang", "m.mean", F.coalesce("o.limit", F.lit(every[0])).alias("limit"), F.greatest(F.coalesce("o.most", F.lit(every[1])), F.lit(USUAL)).alias("most")))
    return smoothed(raw).select("doc_id", "lang", "content", "symbols", "cost", "repeats"), limits


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scores, limits = judge(docs, labels)
    joined = scores.alias("s").join(_sent(limits).alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")))
    keep = (F.col("symbols") == 0) | (F.col("cost") <= F.col("limit")) & (F.col("repeats") <= F.col("most"))
    return joined.select("s.doc_id", "s.lang", "content", "symbols", F.exp("cost").alias("perplexity"), F.exp("limit").alias("limit"), keep.alias("keep"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, symbols, perplexity, limit, keep`` for every row of ``docs`` (doc_id, text, lang; more columns are ignored).

    Null and empty texts have no symbols and their language's mean perplexity, so they are kept.  Without any trusted document all are kept.
    """
    return _judged(docs, labels).drop("content")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with all their columns."""
    good = _judged(docs, labels).where("keep").select("doc_id", "lang", "content").distinct().hint("merge")
    same = (F.xxhash64("d.text") == F.col("g.content")) & F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & F.col("d.lang").eqNullSafe(F.col("g.lang"))
    return docs.alias("d").join(good.alias("g"), same, "left_semi")
