"""Labels, families and capture names from text and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from hostwatch import config as C
from hostwatch.functions.scalars import col


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def label_from_text(c: Column | str, label_set: str = "v2", exclude_non_c2: bool = False) -> Column:
    """1 where the text holds a command-and-control label word as a substring.

    ``exclude_non_c2`` additionally turns texts that name another attack class into 0.
    """
    words = {"v1": C.C2_LABELS_V1, "v2": C.C2_LABELS_V2}[label_set]
    text = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    hit = _contains_any(text, words)
    if exclude_non_c2:
        hit = hit & ~_contains_any(text, C.NON_C2_ATTACKS)
    return hit.cast("int")


def path_class(c: Column | str) -> Column:
    """'c2', 'benign' or 'unknown' by the words in a path; c2 words are tested first."""
    text = F.lower(col(c))
    return (F.when(_contains_any(text, C.C2_PATH_WORDS), "c2")
            .when(_contains_any(text, C.BENIGN_PATH_WORDS), "benign").otherwise("unknown"))


def label_from_path(c: Column | str) -> Column:
    return (path_class(c) == "c2").cast("int")


def family_from_path(c: Column | str, style: str = "regex") -> Column:
    """Family by an ordered list of patterns (``regex``) or keywords (``keyword``)."""
    text = F.lower(col(c))
    if style == "regex":
        rules, technique, fallback = C.FAMILY_PATTERNS, C.TECHNIQUE_PATTERN, "unknown"
    elif style == "keyword":
        rules, technique, fallback = C.FAMILY_KEYWORDS, C.KEYWORD_TECHNIQUE_PATTERN, "unknown_c2"
    else:
        raise ValueError(f"unknown style: {style}")
    cases = [(text.rlike(pattern), F.lit(family)) for pattern, family in rules]
    cases.append((text.rlike(technique), F.concat(F.lit("mitre_"), F.regexp_extract(text, technique, 1))))
    if style == "regex":
        cases += [(text.contains(word), F.lit(family)) for word, family in C.DATASET_MARKERS]
    return F.coalesce(*[F.when(test, value) for test, value in cases], F.lit(fallback))


def relative_path(c: Column | str, root: str) -> Column:
    """Path below ``root``, with any scheme prefix dropped."""
    bare = F.regexp_replace(col(c), r"^[a-z0-9]+:/+", "/")
    below = re.sub(r"^[a-z0-9]+:/+", "", root).strip("/")
    base = f"/{below}/" if below else "/"
    return F.when(bare.startswith(base), F.substr(bare, F.lit(len(base) + 1))).otherwise(F.ltrim(F.lit("/"), bare))


def capture_id(c: Column | str, root: str) -> Column:
    """Parent directories below ``root``; 'root' for a file directly in it."""
    rel = relative_path(c, root)
    return F.when(rel.contains("/"), F.regexp_replace(rel, r"/[^/]*$", "")).otherwise(F.lit("root"))


def base_name(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"([^/]+)/*$", 1)


def split_key(by: str = "family", family: Column | str = "c2_family", source: Column | str = "source") -> Column:
    """Group key of a family- or source-separated split."""
    if by == "source":
        return col(source)
    name = col(family)
    return F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("benign_"), col(source))).otherwise(name)
