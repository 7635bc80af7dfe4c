"""Argus and generic delimited flow files, and dispatch by format."""

from __future__ import annotations

import os
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostwatch.operators.flows import standardize_flows
from hostwatch.sources import zeek

SEPARATORS = (",", ";", "\t", "|")


def _with_file(df: DataFrame) -> DataFrame:
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def read_binetflow(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Argus exports, raw columns as text; files may order their columns differently."""
    return read_delimited(spark, paths, ",")


def detect_separator(header: str) -> str:
    """The separator that occurs most in a header line."""
    return max(SEPARATORS, key=lambda s: (header.count(s), -SEPARATORS.index(s)))


def layouts(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Files (given by name, folder or glob pattern) by their header line."""
    paths = zeek.expand(spark, paths)
    with ThreadPoolExecutor(16) as pool:
        heads = list(pool.map(lambda p: (zeek.leading_lines(spark, p) or [""])[0], paths))
    groups: dict[str, list[str]] = {}
    for path, head in zip(paths, heads):
        groups.setdefault(head, []).append(path)
    return groups


def read_layout(spark: SparkSession, head: str, files: Sequence[str], sep: str | None = None) -> DataFrame:
    """Files of one header line as one scan, all columns as text."""
    return _with_file(spark.read.csv(list(files), sep=sep or detect_separator(head), header=True, inferSchema=False))


def read_delimited(spark: SparkSession, paths: Sequence[str], sep: str | None = None) -> DataFrame:
    """Delimited files with a header; the separator is detected per file unless given.

    Files are grouped by their header line, each group is one scan.
    """
    out = None
    for head, files in layouts(spark, paths).items():
        part = read_layout(spark, head, files, sep)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no input files given")
    return out


def _format_of(path: str) -> str:
    name = os.path.basename(path.lower())
    return "binetflow" if name.endswith(".binetflow") else "zeek" if name.endswith(".log") or "conn" in name else "delimited"


def read_flow_files(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, DataFrame]]:
    """Raw flows of files of mixed formats: one (format, rows) per layout, however many files share it.

    Formats go by name as in :func:`read_flows`; logs without a usable Zeek header are read as delimited files.
    """
    named: dict[str, list[str]] = {}
    for path in zeek.expand(spark, paths):
        named.setdefault(_format_of(path), []).append(path)
    out, others = [], named.get("delimited", [])
    if logs := named.get("zeek"):
        fields = zeek.headers(spark, logs)
        usable = [p for p in logs if set(zeek.ZEEK_REQUIRED) <= set(fields.get(p, ()))]
        others = others + [p for p in logs if p not in set(usable)]
        if usable:
            out.append(("zeek", zeek.read_zeek(spark, usable).rows))
    for kind, files in (("binetflow", named.get("binetflow", [])), ("delimited", others)):
        if files:
            out += [(kind, read_layout(spark, head, same, "," if kind == "binetflow" else None)) for head, same in layouts(spark, files).items()]
    return out


def read_flows(spark: SparkSession, path: str, format: str | None = None) -> tuple[DataFrame, str]:
    """Raw flows of one path and the format they were read as: ``binetflow``, ``zeek`` or ``delimited``.

    By name: ``.binetflow`` is Argus; ``.log`` or a name with "conn" is Zeek, with the delimited reader as
    the way out when the file has no Zeek header.
    """
    guess = format or _format_of(path)
    if guess == "binetflow":
        return read_binetflow(spark, [path]), guess
    if guess == "zeek":
        try:
            return zeek.read_zeek(spark, [path]).rows, guess
        except ValueError:
            if format:
                raise
    return read_delimited(spark, [path]), "delimited"


def read_standard_flows(spark: SparkSession, path: str, format: str | None = None) -> tuple[DataFrame, str]:
    """``read_flows`` with canonical column names, parsed time and endpoints."""
    raw, kind = read_flows(spark, path, format)
    return standardize_flows(raw), kind
