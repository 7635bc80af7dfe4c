"""Dataset building: sampling, splits, leakage, overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostwatch.catalog import query, sql
from hostwatch.catalog.frames import tidy
from hostwatch.functions.labels import split_key
from hostwatch.operators import dedup as DD, sampling as SA, splits as SP
from hostwatch.sources import tables as T


def samples(spark, sf):
    return T.samples_from_documents(spark, sf)


KEYED = f"WITH {sql.SAMPLES}"
RANKED = f"{KEYED}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS r, count(*) OVER (PARTITION BY label) AS c, sum(label) OVER () AS n1, count(*) OVER () AS n FROM samples)"


@query("p32_split_keys", f"{KEYED} SELECT sample_id, CASE WHEN c2_family = '' THEN 'benign_' || source ELSE c2_family END AS family_key, source AS source_key FROM samples")
def p32(spark, sf):
    return samples(spark, sf).select("sample_id", split_key("family").alias("family_key"), split_key("source").alias("source_key"))


@query("d01_mix_ratio", f"{RANKED} SELECT sample_id, label FROM n WHERE label = 1 OR r <= least(CAST(floor(n1 / CAST(0.15 AS DOUBLE)) AS BIGINT) - n1, c)")
def d01(spark, sf):
    s = samples(spark, sf)
    return SA.mix(s.filter("label = 1"), s.filter("label = 0"), 0.15).select("sample_id", "label")


@query("d02_rebalance", f"{RANKED} SELECT sample_id, label FROM n WHERE label = 1 OR r <= CAST(floor(n1 / CAST(0.3 AS DOUBLE)) AS BIGINT) - n1")
def d02(spark, sf):
    return SA.rebalance(samples(spark, sf), 0.3).select("sample_id", "label")


@query("d02_rebalance_unreachable", f"{KEYED} SELECT sample_id, label FROM samples")
def d02_same(spark, sf):
    return SA.rebalance(samples(spark, sf), 0.001).select("sample_id", "label")


@query("d03_undersample", f"{RANKED} SELECT sample_id, label FROM n WHERE label = 1 OR r <= least(n1 * 10, c)")
def d03(spark, sf):
    return SA.undersample(samples(spark, sf)).select("sample_id", "label")


def _held(fraction: str, base: str, out: str) -> str:
    """Per label: how many rows a stratified split holds out (largest remainder on the training side)."""
    return f"""{out} AS (SELECT label, m, m - (fl + CASE WHEN row_number() OVER (ORDER BY ex - fl DESC, label) <= t - sum(fl) OVER () THEN 1 ELSE 0 END) AS held
  FROM (SELECT label, m, t, m * t / CAST(total AS DOUBLE) AS ex, CAST(floor(m * t / CAST(total AS DOUBLE)) AS BIGINT) AS fl
    FROM (SELECT *, CAST(sum(m) OVER () AS BIGINT) AS total, CAST(sum(m) OVER () - ceil(CAST({fraction} AS DOUBLE) * sum(m) OVER ()) AS BIGINT) AS t FROM {base})))"""


COUNTS = "k AS (SELECT label, count(*) AS m FROM samples GROUP BY label)"


@query("d04_stratified_two_way", f"{RANKED}, {COUNTS}, {_held('0.2', 'k', 'o')} SELECT sample_id, n.label, CASE WHEN r <= held THEN 'val' ELSE 'train' END AS split FROM n JOIN o ON n.label = o.label")
def d04(spark, sf):
    return SP.stratified_two_way(samples(spark, sf), 0.2).select("sample_id", "label", "split")


RANDOM = f"""{RANKED}, {COUNTS}, {_held('0.15', 'k', 'o1')}, k2 AS (SELECT label, m - held AS m FROM o1), {_held('0.15 / (1.0 - CAST(0.15 AS DOUBLE))', 'k2', 'o2')},
  split AS (SELECT n.*, CASE WHEN r <= o1.held THEN 'test' WHEN r <= o1.held + o2.held THEN 'val' ELSE 'train' END AS split FROM n JOIN o1 ON n.label = o1.label JOIN o2 ON n.label = o2.label)"""


@query("d05_stratified_three_way", f"{RANDOM} SELECT sample_id, label, split FROM split")
def d05(spark, sf):
    return SP.random_stratified(samples(spark, sf)).select("sample_id", "label", "split")


def _by_family(away: str) -> str:
    """Split by held-out families (condition on ``f.pos``), benign rows sampled."""
    return f"""{KEYED}, fams AS (SELECT c2_family, row_number() OVER (ORDER BY md5('42:' || c2_family)) AS pos, count(*) OVER () AS nf FROM samples WHERE label = 1 GROUP BY c2_family),
  g AS (SELECT s.*, CASE WHEN label = 0 THEN 'benign' WHEN {away} THEN 'away' ELSE 'kept' END AS grp FROM samples s LEFT JOIN fams f ON s.label = 1 AND s.c2_family = f.c2_family),
  n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY h) AS r FROM g),
  b AS (SELECT count(*) AS nb, greatest(1, CAST(floor(count(*) * CAST(0.15 AS DOUBLE)) AS BIGINT)) AS bt FROM g WHERE grp = 'benign'),
  k AS (SELECT 0 AS label, nb - bt AS m FROM b UNION ALL SELECT 1, count(*) FROM g WHERE grp = 'kept'), {_held('0.15', 'k', 'o')},
  split AS (SELECT n.*, CASE WHEN grp = 'away' THEN 'test' WHEN grp = 'benign' AND r <= bt THEN 'test' WHEN grp = 'benign' AND r <= bt + held THEN 'val'
    WHEN grp = 'kept' AND r <= held THEN 'val' ELSE 'train' END AS split FROM n JOIN o ON n.label = o.label, b)"""


FAMILY = _by_family("f.pos <= least(greatest(1, CAST(floor(nf * CAST(0.15 AS DOUBLE)) AS BIGINT)), nf - 1)")
ZERO_SHOT = _by_family("f.pos <= greatest(1, CAST(floor(nf * CAST(0.3 AS DOUBLE)) AS BIGINT))")
SPLIT_COLUMNS = ("sample_id", "label", "c2_family", "source", "split")


@query("d06_family_split", f"{FAMILY} SELECT {', '.join(SPLIT_COLUMNS)} FROM split")
def d06(spark, sf):
    return SP.family_separated(samples(spark, sf)).select(*SPLIT_COLUMNS)


@query("d06_family_split_explicit", _by_family("f.c2_family IN ('de', 'fr')") + f" SELECT {', '.join(SPLIT_COLUMNS)} FROM split")
def d06_explicit(spark, sf):
    return SP.family_separated(samples(spark, sf), held_out_families={"de", "fr", "absent"}).select(*SPLIT_COLUMNS)


@query("d07_source_split", f"""{KEYED}, srcs AS (SELECT source, row_number() OVER (ORDER BY md5('42:' || source)) AS pos, count(*) OVER () AS ns FROM samples GROUP BY source),
  g AS (SELECT s.*, CASE WHEN pos <= least(greatest(1, CAST(floor(ns * CAST(0.15 AS DOUBLE)) AS BIGINT)), ns - 1) THEN 'away' ELSE CAST(label AS VARCHAR) END AS grp FROM samples s JOIN srcs USING (source)),
  n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY h) AS r FROM g), k AS (SELECT label, count(*) AS m FROM g WHERE grp <> 'away' GROUP BY label), {_held('0.15', 'k', 'o')}
  SELECT sample_id, n.label, c2_family, source, CASE WHEN grp = 'away' THEN 'test' WHEN r <= held THEN 'val' ELSE 'train' END AS split FROM n JOIN o ON n.label = o.label""")
def d07(spark, sf):
    return SP.source_separated(samples(spark, sf)).select(*SPLIT_COLUMNS)


TIME = """t AS (SELECT *, row_number() OVER (ORDER BY day, h) AS r, count(*) OVER () AS n FROM (SELECT *, floor(start_ts / 864000) * 864000 AS day FROM samples)),
  split AS (SELECT *, CASE WHEN r <= CAST(floor(CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) * (1 - CAST(0.15 AS DOUBLE))) AS BIGINT) THEN 'train'
    WHEN r <= CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM t)"""


@query("d08_time_split", f"{KEYED}, {TIME} SELECT sample_id, label, split FROM split")
def d08(spark, sf):
    # Times in steps of ten days, so that the cuts fall into groups of equal times.
    s = samples(spark, sf).withColumn("start_ts", F.floor(F.col("start_ts") / 864000) * F.lit(864000.0))
    return SP.time_separated(s).select("sample_id", "label", "split")


@query("d09_zero_shot_split", f"{ZERO_SHOT} SELECT {', '.join(SPLIT_COLUMNS)} FROM split")
def d09(spark, sf):
    return SP.zero_shot(samples(spark, sf)).select(*SPLIT_COLUMNS)


PAIR_COUNTS = """CAST(sum(tr * va) AS BIGINT) AS train_val, CAST(sum(tr * te) AS BIGINT) AS train_test, CAST(sum(va * te) AS BIGINT) AS val_test"""
SEEN = "max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS tr, max(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS va, max(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS te"


@query("d11_leakage", f"""{FAMILY} SELECT 'id' AS what, {PAIR_COUNTS} FROM (SELECT sample_id, {SEEN} FROM split GROUP BY sample_id)
  UNION ALL SELECT 'family', {PAIR_COUNTS} FROM (SELECT c2_family, {SEEN} FROM split WHERE label = 1 GROUP BY c2_family)
  UNION ALL SELECT 'source', {PAIR_COUNTS} FROM (SELECT source, {SEEN} FROM split GROUP BY source)""")
def d11(spark, sf):
    return SP.leakage(SP.family_separated(samples(spark, sf)))


@query("d11_content_leakage", f"""{RANDOM}, c AS (SELECT md5(d.text) AS sample_id, split FROM split JOIN documents d ON d.doc_id = split.sample_id)
  SELECT 'id' AS what, {PAIR_COUNTS} FROM (SELECT sample_id, {SEEN} FROM c GROUP BY sample_id)""")
def d11_content(spark, sf):
    split = SP.random_stratified(samples(spark, sf)).select("sample_id", "split")
    docs = T.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.md5("text").alias("content"))
    return SP.leakage(split.join(docs, "sample_id"), sample_id="content")


def _list(expr: str, where: str) -> str:
    return f"coalesce(string_agg(DISTINCT {expr}, ',' ORDER BY {expr}) FILTER ({where}), '')"


@query("d12_split_summary", f"""{FAMILY} SELECT 'family_separated' AS strategy, count(*) AS total_samples, count(*) FILTER (split = 'train') AS train_size, count(*) FILTER (split = 'val') AS val_size,
  count(*) FILTER (split = 'test') AS test_size, {_list('c2_family', "label = 1 AND split = 'train'")} AS train_families, {_list('c2_family', "label = 1 AND split = 'val'")} AS val_families,
  {_list('c2_family', "label = 1 AND split = 'test'")} AS test_families, {_list('source', "split = 'train'")} AS train_sources, {_list('source', "split = 'test'")} AS test_sources,
  '' AS family_overlap_train_test FROM split""")
def d12(spark, sf):
    d = SP.split_summary(SP.family_separated(samples(spark, sf)), "family_separated")
    return d.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in d.dtypes])


@query("d13_split_report", f"""{FAMILY} SELECT split, count(*) AS total, CAST(sum(label) AS BIGINT) AS c2, CAST(count(*) - sum(label) AS BIGINT) AS benign,
  round(100 * CAST(sum(label) AS DOUBLE) / count(*), 6) AS c2_pct FROM split GROUP BY split""")
def d13(spark, sf):
    return tidy(SP.split_report(SP.family_separated(samples(spark, sf))))


@query("d14_host_diversity", f"{FAMILY} SELECT split, count(DISTINCT host_id) AS unique_hosts, count(*) AS sessions FROM split GROUP BY split")
def d14(spark, sf):
    return SP.host_diversity(SP.family_separated(samples(spark, sf)))


def contents(spark, sf):
    """Labelled documents as the candidate set, all others as the corpus."""
    d = T.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("content"))
    labelled = T.table(spark, sf, "labels").select("doc_id")
    return d.join(labelled, "doc_id", "left_semi"), d.join(labelled, "doc_id", "left_anti")


HALVES = """WITH a AS (SELECT doc_id, md5(text) AS c FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
  b AS (SELECT md5(text) AS c FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""


@query("d15_overlap", f"""{HALVES} SELECT count(*) AS candidates, count(*) FILTER (c IN (SELECT c FROM b)) AS shared,
  round(count(*) FILTER (c IN (SELECT c FROM b)) / CAST(count(*) AS DOUBLE), 6) AS rate FROM a""")
def d15(spark, sf):
    return tidy(DD.overlap(*contents(spark, sf)))


@query("d15_unseen", f"{HALVES} SELECT doc_id FROM a WHERE c NOT IN (SELECT c FROM b)")
def d15_unseen(spark, sf):
    return DD.unseen(*contents(spark, sf)).select("doc_id")


@query("d16_combine", f"{KEYED} SELECT sample_id, label, md5('7:' || CAST(sample_id AS VARCHAR)) AS shuffle_key FROM samples")
def d16(spark, sf):
    s = samples(spark, sf)
    return SA.combine(s.filter("label = 1"), s.filter("label = 0"), seed=7).select("sample_id", "label", "shuffle_key")


FIRST_SOURCE = "(SELECT min(source) FROM samples)"


@query("d17_enrich_benign", f"""{KEYED}, donor AS (SELECT *, row_number() OVER (ORDER BY h) AS r FROM samples WHERE label = 0 AND source = {FIRST_SOURCE})
  SELECT sample_id, label FROM samples WHERE label = 1 UNION ALL SELECT sample_id, label FROM donor WHERE r <= 20""")
def d17(spark, sf):
    s = samples(spark, sf)
    first = s.agg(F.min("source")).first()[0]
    return SA.enrich_benign(s.filter("label = 1"), s.filter(F.col("source") == first), 20).select("sample_id", "label")


@query("j01_attach_metadata", f"{KEYED} SELECT s.sample_id, s.label, d.n_chars FROM samples s JOIN documents d ON s.sample_id = d.doc_id")
def j01(spark, sf):
    docs = T.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "n_chars")
    return samples(spark, sf).join(docs, "sample_id").select("sample_id", "label", "n_chars")


@query("j05_union_parts", f"{KEYED} SELECT source, count(*) AS n FROM samples GROUP BY source")
def j05(spark, sf):
    s = samples(spark, sf)
    return SA.combine(s.filter("label = 0"), s.filter("label = 1")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("j06_set_membership", f"{FAMILY} SELECT DISTINCT c2_family FROM split WHERE split = 'test' AND label = 1 AND c2_family NOT IN (SELECT c2_family FROM split WHERE split = 'train')")
def j06(spark, sf):
    s = SP.family_separated(samples(spark, sf)).filter("label = 1")
    test, train = (s.filter(F.col("split") == n).select("c2_family").distinct() for n in ("test", "train"))
    return test.exceptAll(train)
