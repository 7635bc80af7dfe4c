"""Alignment of two tokenizers against both libraries and a plain loop."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from hostwatch.llm import alignment as A
from hostwatch.llm import queries

FIRST, SECOND = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


class Plain:
    """Whole texts encoded by the libraries, groups and links by loops."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(FIRST)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=SECOND)
        self.a_bytes = {int(n): base64.b64decode(t) for t, n in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}

    def b_byte(self, n):
        p = self.b.id_to_piece(n)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode()

    def align(self, text):
        """(groups text, links as a list, tokens of each) or None."""
        if not text:
            return None
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a_bytes, b_bytes = [self.a_bytes[n] for n in a], [self.b_byte(n) for n in b]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return None
        spans = []
        for ids, kind in ((a, a_bytes), (b, b_bytes)):
            at, rows = 0, []
            for n, t in zip(ids, kind):
                rows.append((n, at, at + len(t)))
                at += len(t)
            spans.append(rows)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(n) for n, _, e in rows if low < e <= c) for rows in spans))
            low = c
        links = [(m, n) for m, s, e in spans[0] for n, t, f in spans[1] if s < f and t < e]
        return ";".join(groups), links, len(a), len(b)

    def report(self, rows):
        found = [(d, self.align(t)) for d, t in rows]
        count = Counter(p for _, f in found if f for p in set(f[1]))
        highest = defaultdict(int)
        for (m, _), n in count.items():
            highest[m] = max(highest[m], n)
        out = []
        for d, f in found:
            if not f:
                out.append((d, 0, 0, 0, 0, 0, 0, ""))
                continue
            groups, links, a, b = f
            out.append((d, a, b, groups.count(";") + 1, len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()))
        return sorted(out, key=str)


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def kinds():
    return A.tokens(FIRST, SECOND)


ODD = ["", " ", "a", "  two  spaces ", "tab\tand\nline \n x", "<|endoftext|> is text", "</s><s> <unk> <0x41>", "x▁y", "▁", "é́ ﬁ ligature", "日本語のテキスト 中文", "👩‍👩‍👧 emoji", "\x00 zero", "don't can't I'll",
       "a　b  c", "ends with space ", "123456 7.8,9", "\r\n", "word" * 300, "ÄÖÜ straße", "…—“quotes”", "ab  c<s> </s>", "﻿mark", "ʼn Ǆ", "a​b"]


def check(plain, kinds, text, step):
    """Closed words put together, and the ranges of the whole text joined, are what the plain loop gives."""
    entry, want = kinds.encode(text) if text else None, plain.align(text)
    assert (entry is None) == (want is None)
    if want:
        groups, linked, n_a, _ = want
        assert entry[0].decode() == groups and entry[2] == n_a
        assert Counter(np.frombuffer(entry[1], np.int64).tolist()) == Counter(m * A.SECOND + n for m, n in linked)
        f = A.whole_of(A.fold(ranges(plain, kinds, text, step), kinds.sizes), kinds.sizes)
        assert f.closed.decode() == groups and f.groups == groups.count(";") + 1
        assert dict(zip(f.pairs.tolist(), f.times.tolist())) == Counter(m * A.SECOND + n for m, n in linked)


def ranges(plain, kinds, text, step):
    a, b = plain.a.encode(" " + text, add_special_tokens=False).ids, plain.b.encode(text)
    return A.fragments(kinds, np.array(a, np.uint32).tobytes(), np.array(b, np.int64), step)


@pytest.mark.parametrize("step", [1, 3, 1 << 14])
def test_odd_texts(plain, kinds, step):
    for text in ODD + [" ".join(ODD)]:
        check(plain, kinds, text, step)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'abcdeéß日.,-1▁<s>"), st.characters(exclude_categories=("Cs",))), max_size=60), st.integers(1, 9))
def test_any_text(text, step):
    check(PLAIN, A.tokens(FIRST, SECOND), text, step)


PLAIN = Plain()


def test_fragments_are_a_monoid(plain, kinds):
    row = ranges(plain, kinds, " ".join(["resultant tokenization", "überraschung déjà-vu", "x" * 40]), 2)
    want = A.fold(row, kinds.sizes)
    rng = random.Random(1)
    same = lambda x, y: all(np.array_equal(u, v) for u, v in zip(x.head + x.tail + (x.pairs, x.times), y.head + y.tail + (y.pairs, y.times))) and x.closed == y.closed
    for _ in range(20):
        left = list(row)
        while len(left) > 1:
            n = rng.randrange(len(left) - 1)
            left[n:n + 2] = [A.combine(left[n], left[n + 1], kinds.sizes)]
        assert same(left[0], want)
    assert same(A.combine(A.EMPTY, want, kinds.sizes), want) and same(A.combine(want, A.EMPTY, kinds.sizes), want)
    assert any(not f.cut for f in row) and any(f.cut for f in row)


def test_table(spark, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    small = [(d, t) for d, t in rows if len(t or "") < 6000]
    got = sorted(map(tuple, A.report(spark.createDataFrame(small, "doc_id long, text string").repartition(3), FIRST, SECOND).collect()), key=str)
    assert got == plain.report(small)
    assert queries.op12_alignment(spark, SMALL).count() == len(rows)


def test_long_texts_over_tasks_and_odd_rows(spark, plain):
    rng = random.Random(4)
    words = ["tokenization", "überraschung", "the", "a", "déjà", "日本語", "don't", "x" * 90, "3.14"]
    rows = [(n, t) for n, t in enumerate(ODD)] + [(None, "a null id"), (None, None), (3, None), (3, "a"), (3, "a"), (7, "\x00 zero")]
    rows += [(100 + n, " ".join(rng.choices(words, k=k))) for n, k in enumerate((5, 60, 400, 900))] + [(200, "日" * 900), (201, "x▁y " * 200)]
    df = spark.createDataFrame([(*r, 1, "", "") for r in rows], "doc_id long, text string, n_a long, groups string, block string").repartition(3)
    want = plain.report(rows)
    for long in (40, 1 << 16):  # the smallest parts take several steps of the tree
        assert sorted(map(tuple, A.report(df, FIRST, SECOND, long=long).collect()), key=str) == want
    assert A.report(df.where("false"), FIRST, SECOND).count() == 0
    groups = {r.doc_id: r.groups for r in A.align(df.where("doc_id >= 100"), FIRST, SECOND, long=40).collect()}
    assert groups == {d: (plain.align(t) or ("",))[0] for d, t in rows if d is not None and d >= 100}
