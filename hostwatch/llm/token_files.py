"""Token ids in binary blocks with shuffled planes.

The ids of all documents, in ascending ``doc_id`` order, form one sequence.  A shard is a stretch of it, written by one
task as one Parquet file in ``<path>/blocks``; a row of it is a block of a fixed number of ids (the last one of a shard
is shorter).  A block's 32-bit ids are transposed into byte or bit planes; planes behind the last one that is not zero
are left out, and each plane is compressed with zstandard by itself.  ``<path>/index`` is the chunk index: the place of every
block in the sequence, its plane sizes and a checksum.  Spark's commit protocol makes the files whole when tasks are
lost and run again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_IDS = 65_536
LEVEL = 3

#: A document's part in a block: its number in the shard, its place there, ids of it before and in this block, whether it ends here.
_PART = pa.struct([("doc_no", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("skip", pa.int64()), ("n", pa.int64()), ("ends", pa.bool_())])
_BLOCK = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("kind", pa.string()),
                    ("crc32", pa.int64()), ("planes", pa.list_(pa.binary())), ("parts", pa.list_(_PART))])
_BLOCK_SQL = ("shard long, block long, first long, n_ids long, kind string, crc32 long, planes array<binary>, "
              "parts array<struct<doc_no: long, doc_id: long, start: long, skip: long, n: long, ends: boolean>>")


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of unsigned 32-bit ids, the lowest first, without those that are zero behind the last one that is not."""
    if kind == "byte":
        planes = np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T)
    else:
        planes = np.stack([np.packbits((ids >> b).astype(np.uint8) & 1) for b in range(32)])
    used = np.flatnonzero(planes.any(axis=1))
    return [p.tobytes() for p in planes[:used[-1] + 1 if used.size else 0]]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    ids = np.zeros(n, "<u4")
    for b, plane in enumerate(planes):
        values = np.frombuffer(plane, np.uint8)
        ids |= (values.astype(np.uint32) << 8 * b) if kind == "byte" else (np.unpackbits(values, count=n).astype(np.uint32) << b)
    return ids


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = BLOCK_IDS, kind: str = "byte", level: int = LEVEL) -> None:
    """Write all ``docs`` (doc_id, text; more columns are ignored) to ``path``.

    Each document has the ids of its whole text and ``end_id``; null texts count as empty.  Null ids come last; rows that
    share an id stand next to each other, ordered by a hash of their text.  An empty table gives files without blocks.
    """
    def run(batches):
        import zstandard
        from pyspark import TaskContext

        from hostwatch.llm.tokens import crc32, encoder

        encode, end, pack = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes(), zstandard.ZstdCompressor(level=level)
        shard, first, block, doc_no, size = TaskContext.get().partitionId(), 0, 0, 0, 4 * block_ids
        buffer, parts, place = bytearray(), [], 0

        def flush():
            nonlocal first, block, buffer, parts
            raw = bytes(buffer[:size])
            n = len(raw) // 4
            row = {"shard": shard, "block": block, "first": first, "n_ids": n, "kind": kind, "crc32": crc32(raw),
                   "planes": [pack.compress(p) for p in to_planes(np.frombuffer(raw, "<u4"), kind)], "parts": parts}
            first, block, buffer, parts = first + n, block + 1, buffer[size:], []
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n, done = len(ids) // 4, 0
                while done < n:
                    take = min(n - done, block_ids - len(buffer) // 4)
                    buffer += ids[4 * done:4 * (done + take)]
                    parts.append({"doc_no": doc_no, "doc_id": doc, "start": place, "skip": done, "n": take, "ends": done + take == n})
                    done += take
                    if len(buffer) == size:
                        yield flush()
                place, doc_no = place + n, doc_no + 1
        if buffer:
            yield flush()

    keys = [F.col("doc_id").asc_nulls_last(), F.col("hash")]
    blocks = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, _BLOCK_SQL)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    heads = spark.read.schema(_BLOCK_SQL).parquet(f"{path}/blocks").select("shard", "block", "first", "n_ids", "kind", "crc32",
                                                                          F.transform("planes", F.length).alias("plane_bytes"))
    per_shard = heads.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # a row per writing task
    before, starts = 0, []
    for shard, n in sorted((r.shard, r.n) for r in per_shard):
        starts.append((shard, before))
        before += n
    heads.join(spark.createDataFrame(starts, "shard long, shard_start long"), "shard").write.parquet(f"{path}/index")


def combine(first: int, second: int, length: int) -> int:
    """The crc32 of two strings put together, from the crc32 of each and the length in bytes of the second one.

    A crc is a polynomial over two elements, kept with its lowest power in the highest bit; zeros that follow multiply it
    by x to the power 8 * length, and that power comes from repeated squaring.
    """
    poly, one = 0xEDB88320, 1 << 31

    def times(a: int, b: int) -> int:
        out = 0
        for bit in range(31, -1, -1):
            if a >> bit & 1:
                out ^= b
            b = b >> 1 ^ (poly if b & 1 else 0)
        return out

    power, square, bits = one, 1 << 23, length  # square is x to the 8th
    while bits:
        if bits & 1:
            power = times(power, square)
        square, bits = times(square, square), bits >> 1
    return times(first, power) ^ second


_FOUND = "shard long, doc_no long, doc_id long, start long, skip long, n long, crc long, whole boolean"


def _checked(batches):
    """Decode blocks; one row per document part with the crc32 of its ids."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            raw = from_planes([unpack.decompress(p) for p in row["planes"]], row["n_ids"], row["kind"]).tobytes()
            if zlib.crc32(raw) != row["crc32"]:
                raise ValueError(f"block {row['block']} of shard {row['shard']} is damaged")
            at = 0
            for p in row["parts"]:
                crc = zlib.crc32(raw[4 * at:4 * (at + p["n"])])
                out.append((row["shard"], p["doc_no"], p["doc_id"], p["start"], p["skip"], p["n"], crc, p["ends"] and not p["skip"]))
                at += p["n"]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 7 + [pa.bool_()])],
                                             names=[c.split()[0] for c in _FOUND.split(", ")])


def _joined(batches):
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            crc, n = 0, 0
            for p in row["pieces"]:
                crc = combine(crc, p["crc"], 4 * p["n"]) if n else p["crc"]
                n += p["n"]
            out.append((row["shard"], row["doc_id"], row["start"], n, crc))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)],
                                         names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold of each document: ``doc_id, start, n_tokens, ids_crc32``, from the decoded ids.

    Documents inside one block are complete at once; only the parts of those that cross a block's border are shuffled.
    """
    blocks = spark.read.schema(_BLOCK_SQL).parquet(f"{path}/blocks")
    starts = spark.read.parquet(f"{path}/index").where("block = 0").select("shard", "shard_start")
    parts = blocks.mapInArrow(_checked, _FOUND)
    whole = parts.where("whole").selectExpr("shard", "doc_id", "start", "n AS n_tokens", "crc AS ids_crc32")
    rest = (parts.where("NOT whole").groupBy("shard", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"),
            F.sort_array(F.collect_list(F.struct("skip", "n", "crc"))).alias("pieces"))
            .mapInArrow(_joined, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long"))
    return (whole.unionByName(rest).join(starts, "shard")
            .select("doc_id", (F.col("shard_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The id sequence: one row per block, ``start`` (its place) and ``ids``."""
    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = [{"shard": r["shard"], "block": r["block"], "ids": from_planes([unpack.decompress(p) for p in r["planes"]], r["n_ids"], r["kind"]).astype(np.int64)}
                    for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    blocks = spark.read.schema(_BLOCK_SQL).parquet(f"{path}/blocks").mapInArrow(run, "shard long, block long, ids array<long>")
    places = spark.read.parquet(f"{path}/index").selectExpr("shard", "block", "shard_start + first AS start")
    return blocks.join(places, ["shard", "block"]).select("start", "ids")
