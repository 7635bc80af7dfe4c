"""Zeek logs: header discovery, scan, labelled directory trees."""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hostwatch.config import ZEEK_REQUIRED
from hostwatch.functions import labels as L
from hostwatch.operators.flows import require_columns

FIELDS = "#fields"
#: Files whose content can be damaged as a whole, and what a damaged one says.
COMPRESSED = (".gz", ".bz2", ".zst", ".deflate", ".lz4", ".snappy")
BROKEN = re.compile(r"EOFException[^\n]{0,100}|ZipException[^\n]{0,100}|(?:incorrect|invalid|corrupt|not a gzip|unexpected end|truncated)[^\n]{0,100}", re.IGNORECASE)


@dataclass(frozen=True)
class LogScan:
    """Rows of the readable files, and ``(path, error)`` of the others."""

    rows: DataFrame
    rejected: DataFrame


def list_files(spark: SparkSession, root: str, glob: str) -> list[str]:
    """Files below ``root`` whose name matches, sorted.  Lists names only."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    if not fs.exists(base):
        raise FileNotFoundError(root)
    pattern = jvm.org.apache.hadoop.fs.GlobPattern(glob)
    found, walk = [], fs.listFiles(base, True)
    while walk.hasNext():
        path = walk.next().getPath()
        if pattern.matches(path.getName()):
            found.append(path.toString())
    return sorted(found)


def leading_lines(spark: SparkSession, path: str, comment: str | None = None) -> list[str]:
    """The first line of a file or, with ``comment``, the comment lines it starts with.  Only these are read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
        source = codec.createInputStream(stream) if codec is not None else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8"))
        line, out = reader.readLine(), []
        while line is not None:
            if comment and not line.startswith(comment):
                break
            out.append(line)
            if not comment:
                break
            line = reader.readLine()
        return out
    finally:
        stream.close()


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Field names of every file that declares them at its head; a file whose head can't be read has none."""
    def head(path: str) -> list[str]:
        try:
            return leading_lines(spark, path, "#")
        except Py4JJavaError as e:
            if not BROKEN.search(str(e)):
                raise
            return []

    with ThreadPoolExecutor(16) as pool:
        heads = pool.map(head, paths)
    found = {p: next((line for line in head if line.startswith(FIELDS)), None) for p, head in zip(paths, heads)}
    return {p: tuple(line.split("\t")[1:]) for p, line in found.items() if line is not None}


def broken_bodies(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """Compressed files that can't be read to their end, with the reason.

    All files are read once, as counts of their lines.  Only where that fails, the files are divided, until each broken one is found
    by itself; a failure that does not come from a file's content is raised.
    """
    found: dict[str, str] = {}

    def check(some: list[str]) -> None:
        try:
            spark.read.option("ignoreCorruptFiles", False).text(some).agg(F.count("value")).first()
        except Exception as e:
            said = str(e)
            if not BROKEN.search(said):
                raise
            if len(some) == 1:
                found[some[0]] = BROKEN.search(said)[0]
                return
            step = -(-len(some) // 8)
            for at in range(0, len(some), step):
                check(some[at:at + step])

    closed = [p for p in paths if p.endswith(COMPRESSED)]
    if closed:
        check(closed)
    return found


def scan(spark: SparkSession, paths: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Files of one layout, all columns as text; ``-`` is null."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    rows = spark.read.schema(schema).csv(list(paths), sep="\t", comment="#", quote="", nullValue="-", mode="PERMISSIVE")
    return rows.withColumn("source_file", F.col("_metadata.file_path"))


def read_zeek(spark: SparkSession, paths: Sequence[str], required: Sequence[str] = ZEEK_REQUIRED,
              on_error: str = "raise") -> LogScan:
    """Read logs of any column order; ``paths`` may be files, folders or glob patterns.  Files are grouped by header; each
    group is one scan.

    A file without a header or required columns raises, or with ``on_error="quarantine"`` is listed in
    ``rejected``; so is then a compressed file that can't be read to its end, with none of its rows among the others.
    """
    paths = expand(spark, paths)
    found = headers(spark, paths)
    groups: dict[tuple[str, ...], list[str]] = {}
    rejected: list[tuple[str, str]] = []
    for path in paths:
        fields = found.get(path)
        missing = [r for r in required if r not in (fields or ())]
        if fields is None:
            rejected.append((path, f"no '{FIELDS}' line"))
        elif missing:
            rejected.append((path, f"missing required fields: {missing}"))
        else:
            groups.setdefault(fields, []).append(path)
    if on_error == "quarantine":
        damaged = broken_bodies(spark, [p for files in groups.values() for p in files])
        rejected += sorted(damaged.items())
        groups = {fields: left for fields, files in groups.items() if (left := [p for p in files if p not in damaged])}
    if rejected and on_error != "quarantine":
        raise ValueError("; ".join(f"{p}: {e}" for p, e in rejected))
    bad = spark.createDataFrame(rejected, "path string, error string")
    parts = [scan(spark, files, fields) for fields, files in groups.items()]
    if not parts:
        if on_error != "quarantine":
            raise ValueError("no log files given")
        return LogScan(spark.createDataFrame([], ", ".join(f"`{r}` string" for r in (*required, "source_file"))), bad)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return LogScan(require_columns(rows, required, "log"), bad)


def labelled_files(spark: SparkSession, root: str) -> list[str]:
    """``conn.log`` files below ``root`` (or ``conn*.log`` where there is none)."""
    return list_files(spark, root, "conn.log") or list_files(spark, root, "conn*.log")


def read_labelled_zeek(spark: SparkSession, root: str) -> LogScan:
    """A directory tree of logs with label, class and capture taken from the paths; bad files are set aside."""
    files = labelled_files(spark, root)
    found = read_zeek(spark, files, on_error="quarantine")
    rel = L.relative_path("source_file", root)
    rows = found.rows.withColumns({"label": L.label_from_path(rel), "path_class": L.path_class(rel),
                                   "capture_id": L.capture_id("source_file", root), "source": F.lit("uwf_zeekdata24")})
    return LogScan(rows, found.rejected)


def read_aux_logs(spark: SparkSession, root: str, kind: str) -> DataFrame | None:
    """``dns.log`` or ``ssl.log`` files below ``root``; None where there are none."""
    if kind not in ("dns", "ssl"):
        raise ValueError(f"unknown log kind: {kind}")
    files = list_files(spark, root, f"{kind}.log")
    return read_zeek(spark, files, required=(), on_error="quarantine").rows if files else None


def expand(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Full file names for files, folders (all files below them) and glob patterns, in the order given."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        found = fs.globStatus(p)
        if found is None or not len(found):
            raise FileNotFoundError(path)
        for status in found:
            name = status.getPath().toString()
            out += list_files(spark, name, "*") if status.isDirectory() else [fs.makeQualified(status.getPath()).toString()]
    return out
