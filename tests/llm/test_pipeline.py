"""The pipeline stage by stage against plain versions of what each stage decides."""

import zlib
from array import array

import corpus_pipeline as pipeline
import numpy as np
from conftest import SMALL
from test_pii import base
from test_shingles import groups

from hostwatch.llm import quality, queries


def test_stages(spark, tmp_path):
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mix", "pack"]
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, seen = documents, [documents]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    assert all(d.dtypes == documents.dtypes for d in seen[1:5])
    raw, good, unique, clean, mix = ({} for _ in range(5))
    for df, out in zip(seen, (raw, good, unique, clean, mix)):
        for r in df.collect():
            out.setdefault(r.doc_id, []).append(r)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = {r.doc_id for r in quality.classify(documents, labels).where("keep").collect()}
    assert good.keys() == kept and all(good[d] == raw[d] for d in kept) and len(kept) < len(raw)
    least = {}
    for d, group in zip(good, groups([r[0].text for r in good.values()])):
        least[group] = min(d, least.get(group, d))
    assert unique.keys() == set(least.values()) and all(unique[d] == good[d] for d in unique)
    assert clean.keys() == unique.keys()
    for d, (r,) in clean.items():
        assert (r.text == unique[d][0].text) == (not base(unique[d][0].text)) and r.n_chars == len(r.text) and r[2:4] == unique[d][0][2:4]
    size = {d: len(r[0].text.split()) for d, r in clean.items()}
    assert set(mix) <= set(clean) and all(len(r) <= 2 and r == clean[d] * len(r) for d, r in mix.items())
    assert abs(sum(size[d] * len(r) for d, r in mix.items()) - 1.5 * sum(size.values())) <= sum(
        max(size[d] for d in size if clean[d][0].source == s) for s in {r[0].source for r in clean.values()})
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(queries.tokenizer())
    want, fills = [], {}
    for d, rows in mix.items():
        ids = encode.encode(rows[0].text, add_special_tokens=False).ids + [2]
        cuts = [0, *range(min(len(ids) % 1024 or 1024, len(ids)), len(ids) + 1, 1024)]
        want += [(d, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))] * len(rows)
    packed = seen[5].collect()
    assert sorted(tuple(r)[:5] for r in packed) == sorted(want)
    for r in packed:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 1024 and len(fills) <= np.ceil(sum(fills.values()) / 1024) + 3


def test_odd_documents(spark, tmp_path):
    rows = [(1, "one text of some words", "en", "a", 22), (1, "one text of some words", "en", "a", 22), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "no id", "en", "a", 5),
            (4, "mail me: x@y.zz now " * 2000, "xx", "b", 7), (5, "one text of some words", "en", "a", 22)]
    docs = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copies int, spans string, cost double")
    (tmp_path / "in").mkdir()
    docs.write.parquet(str(tmp_path / "in/documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "in/labels.parquet"))
    got = pipeline.run(spark, str(tmp_path / "in")).collect()
    assert {r.doc_id for r in got} <= {1, 2, 3, 4}
    redacted = pipeline.without_personal_data(spark, docs, "").where("doc_id = 4").first().text
    assert "@" not in redacted and redacted.count("[EMAIL]") == 2000
    docs.where("false").write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.read.parquet(str(tmp_path / "in/labels.parquet")).write.parquet(str(tmp_path / "none/labels.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
