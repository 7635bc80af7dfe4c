"""The queries of the operators, with production parameters over whole tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.llm.common import shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_pack")
def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostwatch.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer())


MIX_SQL = r"""WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM per_source),
levels AS (
  SELECT *, ((SELECT 1.5::DOUBLE * sum(source_size) FROM weighted) - coalesce(sum(cap) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(w) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighted WINDOW p AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)),
found AS (SELECT coalesce((SELECT level FROM levels WHERE level * w < cap ORDER BY cap::DOUBLE / w, source NULLS LAST LIMIT 1), 0) AS level),
targets AS (
  SELECT source, source_size, CASE WHEN cap <= (SELECT level FROM found) * w THEN cap::DOUBLE ELSE (SELECT level FROM found) * w END AS target,
    ('0x' || substr(md5('7:' || coalesce(source, chr(1))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM weighted),
steps AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST))::DOUBLE AS place
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(floor(rate * place + u) - floor(rate * (place - 1) + u), ceil(rate)) * size)::BIGINT AS taken
FROM steps"""


@query("op5_mix", MIX_SQL)
def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostwatch.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostwatch.llm import token_files

    path = shared_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer())
    return token_files.read_documents(spark, path)


def _pii_sql() -> str:
    """Matches between marks, split, and checked one by one; the patterns are the plain ones."""
    byte = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    digits = "regexp_replace(found, '[^0-9]', '', 'g')"
    moved = "(substr(replace(found, ' ', ''), 5) || substr(replace(found, ' ', ''), 1, 4))"
    luhn = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN substr({digits}, -k, 1)::INT
      ELSE 2 * substr({digits}, -k, 1)::INT - CASE WHEN substr({digits}, -k, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
    mod97 = f"""list_reduce(list_prepend(0, list_transform(range(1, length({moved}) + 1), lambda k: CASE WHEN substr({moved}, k, 1) < 'A'
      THEN substr({moved}, k, 1)::INT ELSE ascii(substr({moved}, k, 1)) - 55 END)), lambda acc, d: (acc * CASE WHEN d > 9 THEN 100 ELSE 10 END + d) % 97) = 1"""
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 0.7, "mail|contact|write"),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"regexp_matches(found, '^{byte}\.{byte}\.{byte}\.{byte}$')", 0.6, r"\bip\b|address|host|server"),
             ("card", r"[0-9]([\x20-]?[0-9])+", f"length({digits}) BETWEEN 16 AND 19 AND {luhn}", 0.7, "card|visa|credit|payment"),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15", 0.6, "phone|tel|call|mobile|fax"),
             ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", f"NOT regexp_matches(before, '[A-Za-z0-9]$') AND {mod97}", 0.7, "iban|account|bank"),
             ("ssn", r"[0-9]+-[0-9]+-[0-9]+", "NOT regexp_matches(before, '[0-9-]$') AND regexp_matches(found, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$')", 0.3,
              "ssn|social security|tax id"))
    parts = " UNION ALL ".join(
        rf"SELECT doc_id, {n} AS k, '{kind}' AS kind, string_split(regexp_replace(clean, '{pattern}', chr(57344) || '\0' || chr(57344), 'g'), chr(57344)) AS parts FROM texts"
        for n, (kind, pattern, *_) in enumerate(kinds))
    valid = " ".join(f"WHEN '{kind}' THEN {check}" for kind, _, check, _, _ in kinds)
    score = " ".join(f"WHEN '{kind}' THEN round({base} + CASE WHEN regexp_matches(lower(before), '{near}') THEN 0.3 ELSE 0 END, 3)" for kind, _, _, base, near in kinds)
    return rf"""WITH texts AS (SELECT doc_id, replace(coalesce(text, ''), chr(57344), chr(65533)) AS clean FROM documents),
parted AS ({parts}),
places AS (SELECT doc_id, k, kind, parts, unnest(range(2, len(parts) + 1, 2)) AS i FROM parted WHERE len(parts) > 1),
found AS (
  SELECT doc_id, k, kind, parts[i] AS found, right(parts[i - 1], 50) AS before, list_sum(list_transform(parts[1:i - 1], lambda p: length(p)))::BIGINT AS start FROM places),
spans AS (
  SELECT *, start + length(found) AS stop, (CASE kind {score} END)::DOUBLE AS score FROM found WHERE CASE kind {valid} END),
kept AS (SELECT *, kind || ':' || start || ':' || stop AS written FROM spans WHERE score >= 0.5),
summed AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card,
    count(*) FILTER (WHERE kind = 'phone') AS n_phone, string_agg(written, ',' ORDER BY k, start) FILTER (WHERE k < 4) AS base,
    string_agg(written, ',' ORDER BY k, start) AS spans, list(score ORDER BY k, start) AS scores FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, []) AS scores
FROM documents d LEFT JOIN summed s USING (doc_id)"""


@query("op10_pii", _pii_sql())
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostwatch.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostwatch.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_embedding_dedup", r"""WITH RECURSIVE fine AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
groups AS (SELECT a, min(b) AS smallest FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(g.smallest, e.vec_id)) AS component_id,
  coalesce(e.vec_id <= coalesce(g.smallest, e.vec_id), false) AS kept
FROM embeddings e LEFT JOIN groups g ON g.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id""")
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostwatch.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_top_k", r"""WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostwatch.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostwatch.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostwatch.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_warc")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostwatch.llm.warc import derive, responses

    return derive(responses(table(spark, sf_dir, "pages")))


#: Rules of the contract: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _url_sql() -> str:
    """Rules tried one by one; shares shrunk level by level, each level's strength from its spread."""
    from hostwatch.llm import url_reputation as U

    two = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"
    listed = ", ".join(f"'{s}'" for s in U.TWO_LABEL_SUFFIXES)
    numeric = "regexp_matches(host, '^[0-9.]*$')"
    strength = f"""SELECT 1 / least(greatest(coalesce((sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), {U.LEAST_CORRELATION}),
      {U.LEAST_CORRELATION}::DOUBLE), {U.MOST_CORRELATION}::DOUBLE) - 1 AS strength FROM"""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return rf"""WITH rests AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{U.UPPER}', '{U.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
outcomes AS (
  SELECT p.host, count(*)::DOUBLE AS n, sum(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END)::DOUBLE AS bad
  FROM parsed p JOIN labels l ON l.quality IS NOT NULL AND l.doc_id = TRY_CAST(regexp_extract(p.path, '/([0-9]{{1,18}})', 1) AS BIGINT) GROUP BY p.host),
hosts AS (
  SELECT host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad,
    CASE WHEN {numeric} THEN '' WHEN {two} IN ({listed}) THEN {two} ELSE string_split(host, '.')[-1] END AS suffix,
    CASE WHEN {numeric} THEN host WHEN {two} IN ({listed}) THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE {two} END AS domain
  FROM (SELECT DISTINCT host FROM parsed) LEFT JOIN outcomes USING (host)),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT sum(bad) / nullif(sum(n), 0) FROM hosts) AS prior FROM hosts GROUP BY suffix),
s1 AS ({strength} suffixes WHERE n > 0),
domains AS (
  SELECT d.*, (s.bad + strength * s.prior) / (s.n + strength) AS prior
  FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix) d JOIN suffixes s USING (suffix), s1),
s2 AS ({strength} domains WHERE n > 0),
known AS (SELECT h.*, (d.bad + strength * d.prior) / (d.n + strength) AS prior FROM hosts h JOIN domains d USING (domain), s2),
s3 AS ({strength} known WHERE n > 0),
shares AS (SELECT host, n, bad, (bad + strength * prior) / (n + strength) AS share, n + strength + 1 AS weight FROM known, s3),
facts AS (SELECT host, n::BIGINT AS labelled, bad::BIGINT AS bad, coalesce(greatest(share - {U.DEVIATIONS} * sqrt(share * (1 - share) / weight), 0), 0)::DOUBLE AS bound FROM shares),
rules(rule_host, rule_path, verdict) AS (VALUES {rules}),
fits AS (
  SELECT h.host, p.path, rule_host || rule_path AS rule, verdict FROM (SELECT DISTINCT host FROM parsed) h JOIN (SELECT DISTINCT host, path FROM parsed) p USING (host)
  JOIN rules ON (h.host = rule_host OR ends_with(h.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY h.host, p.path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, verdict = 'block' DESC) = 1)
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, CASE WHEN f.bound > {U.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, f.labelled, f.bad, round(f.bound, 6) AS bound
FROM parsed p JOIN facts f USING (host) LEFT JOIN fits r ON r.host = p.host AND r.path = p.path"""


@query("op11_url_filter", _url_sql())
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostwatch.llm.url_reputation import judge, page_outcomes

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), rules)


@query("op13_hard_negatives", r"""WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM fine a JOIN fine b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostwatch.llm.hard_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from hostwatch.llm.alignment import report

    return report(table(spark, sf_dir, "documents"), tokenizer(), public_tokenizers.path("piece_bpe_32k.model"))
