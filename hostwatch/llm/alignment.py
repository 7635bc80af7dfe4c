"""Alignment of two tokenizers over the same bytes, as an associative monoid of fragments.

A fragment is what a range of bytes knows about its text: the tokens that end in it.  If both tokenizers end a token at the same byte, the
text is cut there; a fragment with a cut is an open prefix (tokens before its first cut), closed groups, and an open suffix
(tokens behind its last cut), one without a cut is all open.  Two neighbours are joined by closing one's suffix with the other's prefix; the
operation is associative, so the ranges of a text may be joined in any tree.

Texts are cut into ranges of ``RANGE`` bytes; a task aligns the ranges of many texts at once and joins those of a text.  A text of more than
``LONG`` characters is first divided at spaces where both tokenizers surely end a token, the parts go to different tasks, and their
fragments are joined by a tree of Spark stages, ``FAN`` at a time.

Words between safe spaces are texts of their own, so the closed fragments of frequent ones are kept and only put together again.

Counts of linked id pairs over all documents: documents are put in blocks of bounded size, a block's distinct pairs are joined with the
counts, shard by shard, and return to their block; no row per document and pair is shuffled.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostwatch.llm.common import cut, stored
from hostwatch.llm.tokens import _LETTERS, _LINES, Encoder, _byte_letters

#: Bytes of a range, characters of a text that stays whole and of a part of a longer one, fragments joined at a step of the tree.
RANGE, LONG, FAN = 1 << 14, 1 << 16, 16
#: Links of a block of documents.
BLOCK = 1 << 21
#: Words that are remembered twice at most, longest of them, and tokens of a word from which on it is aligned in ranges.
CACHED_WORDS, LONGEST_CACHED, LONG_WORD = 200_000, 64, 64
#: A pair of ids as one number: the first id times this plus the second.
SECOND = 1 << 24

#: A space behind a character that is neither white space nor may join with it.
_SAFE = re.compile(r"(?<=[\w!-~¡-ɏ]) ")
_UNSAFE = re.compile(r"(?<![\w!-~¡-ɏ]) ")
#: In pieces: a space behind another sign; letters beside signs.
_INNER_SPACE = re.compile("[^▁]▁")
_MIXED = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ][!-&(-/:-@\[-`{-~]|[!-&(-/:-@\[-`{-~][A-Za-zÀ-ÖØ-öø-ÿ]")


class Fragment(NamedTuple):
    """Tokens of a range: the open prefix as ids (all of them, if there is no cut), closed groups, the open suffix, and the links of closed groups."""
    cut: bool
    head: tuple[np.ndarray, np.ndarray]
    tail: tuple[np.ndarray, np.ndarray]
    closed: bytes
    groups: int
    pairs: np.ndarray
    times: np.ndarray


NO_IDS = np.zeros(0, np.int64)
#: Neutral: no bytes, no tokens.
EMPTY = Fragment(False, (NO_IDS, NO_IDS), (NO_IDS, NO_IDS), b"", 0, NO_IDS, NO_IDS)


def _written(a, b) -> bytes:
    return b"%s|%s" % (",".join(map(str, a.tolist())).encode(), ",".join(map(str, b.tolist())).encode())


def _merged(pairs, times) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and their sums."""
    if not len(pairs):
        return NO_IDS, NO_IDS
    distinct, at = np.unique(pairs, return_inverse=True)
    return distinct, np.bincount(at, weights=times, minlength=len(distinct)).astype(np.int64)


def combine(x: Fragment, y: Fragment, sizes: tuple[np.ndarray, np.ndarray]) -> Fragment:
    """The fragment of two neighbouring ranges; ``sizes`` are the bytes of each id of both tokenizers."""
    if not x.cut:
        head = tuple(np.concatenate(p) for p in zip(x.head, y.head))
        return y._replace(head=head)
    if not y.cut:
        return x._replace(tail=tuple(np.concatenate(p) for p in zip(x.tail, y.head)))
    a, b = (np.concatenate(p) for p in zip(x.tail, y.head))
    closed, groups, parts = [x.closed, y.closed], x.groups + y.groups, [(x.pairs, x.times), (y.pairs, y.times)]
    if len(a):  # both are empty where the ranges meet at a cut
        closed.insert(1, _written(a, b))
        groups += 1
        linked = links(a, b, sizes)
        parts.append((linked, np.ones(len(linked), np.int64)))
    pairs, times = _merged(*(np.concatenate(p) for p in zip(*parts)))
    return Fragment(True, x.head, y.tail, b";".join(c for c in closed if c), groups, pairs, times)


def fold(fragments: list[Fragment], sizes) -> Fragment:
    """All of a row of neighbours, joined as a tree."""
    while len(fragments) > 1:
        fragments = [combine(*fragments[n:n + 2], sizes) if n + 1 < len(fragments) else fragments[n] for n in range(0, len(fragments), 2)]
    return fragments[0] if fragments else EMPTY


def links(a: np.ndarray, b: np.ndarray, sizes) -> np.ndarray:
    """Pairs of overlapping tokens of two token rows over the same bytes: one for each stretch between neighbouring ends of either."""
    ends_a, ends_b = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
    ends = np.union1d(ends_a, ends_b)
    return a[np.searchsorted(ends_a, ends)] * SECOND + b[np.searchsorted(ends_b, ends)]


#: A closed stretch of text: its groups as written, the pairs of its links (8 bytes each, repeats included), tokens of the first kind.
Entry = tuple[bytes, bytes, int]


class _Words(dict):
    """Entries by word; those of the generation before are kept until the next one is full."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, word: str):
        entry = self.old[word] if word in self.old else self.encode(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = entry
        return entry


def _together_entry(entries: list) -> Entry | None:
    try:
        return b";".join([e[0] for e in entries]), b"".join([e[1] for e in entries]), sum([e[2] for e in entries])
    except TypeError:  # one of them has bytes that are not those of the text
        return None


class Tokens:
    """Both tokenizers of a process: ids of texts, bytes of ids, and closed fragments of words."""

    def __init__(self, first: str, second: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece

        self.first = Encoder(first)
        self.first.tokenizer.encode_special_tokens, self.first.special = True, []
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = {c: n for n, c in _byte_letters().items()}
        vocabulary = self.first.tokenizer.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.first.tokenizer.get_added_tokens_decoder().values()}
        self.first_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, n in vocabulary.items():
            self.first_bytes[n] = token.encode() if token in special else bytes(letters[c] for c in token)
        pieces = [self.second.id_to_piece(n) for n in range(self.second.get_piece_size())]
        plain = [n for n in range(len(pieces)) if not self.second.is_byte(n) and not self.second.is_control(n) and not self.second.is_unknown(n)]
        self.second_bytes = [bytes([int(p[3:-1], 16)]) if self.second.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
        self.sizes = tuple(np.array([len(t) for t in kind], np.int64) for kind in (self.first_bytes, self.second_bytes))
        self.lengths = tuple(kind.tolist() for kind in self.sizes)
        self.first_text, self.second_text = ([b"%d" % n for n in range(len(kind))] for kind in (self.first_bytes, self.second_bytes))
        #: Places where no piece of the second kind goes on, so that parts may be encoded by themselves.
        self.at_spaces = not any(_INNER_SPACE.search(pieces[n]) for n in plain)
        self.at_signs = not any(_MIXED.search(pieces[n]) for n in plain)
        feed = self.second.encode("\n")
        self.at_feeds = not any("\n" in pieces[n] for n in plain) and len(feed) == 2 and self.second_bytes[feed[1]] == b"\n"
        self.words, self.stems, self.inner = (_Words(f, CACHED_WORDS) for f in (self._word, self._direct, self._inside))
        self.feed = self._leaf(self.first._direct("\n"), feed[1:], b"\n") if self.at_feeds else None

    def _leaf(self, first: bytes, b: list[int], whole: bytes) -> Entry | None:
        """The closed fragment of a stretch that both kinds begin and end with; None where one's bytes are not those of the text."""
        a = array("I", first).tolist()
        if b"".join([self.second_bytes[n] for n in b]) != whole or b"".join([self.first_bytes[n] for n in a]) != whole:
            return None
        if len(a) + len(b) > LONG_WORD:
            f = whole_of(fold(fragments(self, first, np.array(b, np.int64)), self.sizes), self.sizes)
            return f.closed, np.repeat(f.pairs, f.times).tobytes(), len(a)
        text_a, text_b, of_a, of_b = self.first_text, self.second_text, *self.lengths
        i, j, groups, pairs, m, n = 0, 0, [], [], 0, 0
        end_a, end_b = of_a[a[0]], of_b[b[0]]
        while True:
            pairs.append(a[i] * SECOND + b[j])
            if end_a == end_b:
                groups.append(b"%s|%s" % (text_a[a[i]] if i == m else b",".join([text_a[t] for t in a[m:i + 1]]), text_b[b[j]] if j == n else b",".join([text_b[t] for t in b[n:j + 1]])))
                i, j = i + 1, j + 1
                if i == len(a):
                    return b";".join(groups), array("q", pairs).tobytes(), len(a)
                m, n = i, j
                end_a, end_b = end_a + of_a[a[i]], end_b + of_b[b[j]]
            elif end_a < end_b:
                i += 1
                end_a += of_a[a[i]]
            else:
                j += 1
                end_b += of_b[b[j]]

    def _direct(self, part: str) -> Entry | None:
        """A space and ``part``, by the libraries themselves."""
        a = self.first._spaced(part) if part and " " not in part else self.first._direct(" " + part)
        b = self.second.encode(part) or [self.second.piece_to_id("▁")]  # an empty part is a space alone
        return self._leaf(a, b, b" " + part.encode())

    def _inside(self, part: str) -> Entry | None:
        """``part`` behind a line feed or letters: without a space."""
        return self._leaf(self.first._direct(part), self.second.encode("\n" + part)[2:], part.encode())

    def _word(self, part: str) -> Entry | None:
        """A space and a word, from its letters, signs and lines where all tokens end between them."""
        if self.at_feeds and self.at_signs:
            found = _LETTERS(part)
            if found:
                return self._signed(self.stems, found)
            if "\n" in part and _LINES(part):
                head, *lines = part.split("\n")
                entries = [self.words[head]]
                for line in lines:
                    found = _LETTERS(line)
                    entries += [self.feed, self._signed(self.inner, found) if found else self.inner[line]]
                return _together_entry(entries)
        return self._direct(part)

    def _signed(self, stems: _Words, found) -> Entry | None:
        stem = stems[found[1]]
        return _together_entry([stem, self.inner[found[2]]]) if found[2] else stem

    def encode(self, text: str) -> Entry | None:
        """Space and text, closed.  Text is cut only at spaces where both tokenizers end a token: no piece of either
        goes on behind a sign that is no space with a space."""
        if not self.at_spaces:
            return self._direct(text)
        parts = _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")
        return _together_entry(list(map(self.words.__getitem__, parts)))


_TOKENS: dict[tuple[str, str], Tokens] = {}


def tokens(first: str, second: str) -> Tokens:
    if (first, second) not in _TOKENS:
        _TOKENS[first, second] = Tokens(first, second)
    return _TOKENS[first, second]


def fragments(kinds: Tokens, first: bytes, b: np.ndarray, step: int = RANGE) -> list[Fragment]:
    """The fragments of the ranges of ``step`` bytes of one text."""
    a = np.frombuffer(first, np.uint32).astype(np.int64)
    ends_a, ends_b = np.cumsum(kinds.sizes[0][a]), np.cumsum(kinds.sizes[1][b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    out = []
    for low in range(0, int(ends_a[-1]), step):
        own = cuts[slice(*np.searchsorted(cuts, (low, low + step), "right"))]
        # places in both rows of tokens: where the range begins, behind each cut, where it ends
        at = [np.searchsorted(e, [low, *own, low + step], "right") for e in (ends_a, ends_b)]
        if not len(own):
            out.append(Fragment(False, tuple(kind[s:t] for kind, (s, t) in zip((a, b), at)), (NO_IDS, NO_IDS), b"", 0, NO_IDS, NO_IDS))
            continue
        head, tail = (tuple(kind[p[n]:p[n + 1]] for kind, p in zip((a, b), at)) for n in (0, -2))
        closed = [_written(a[s:t], b[u:v]) for s, t, u, v in zip(at[0][1:-2], at[0][2:-1], at[1][1:-2], at[1][2:-1])]
        linked = links(a[at[0][1]:at[0][-2]], b[at[1][1]:at[1][-2]], kinds.sizes) if closed else NO_IDS
        out.append(Fragment(True, head, tail, b";".join(closed), len(closed), *_merged(linked, np.ones(len(linked)))))
    return out


def parts(text: str, long: int = LONG) -> list[str]:
    """The text cut at the first safe space behind every ``long`` characters; the spaces themselves belong to the parts behind them."""
    out, at = [], 0
    while len(text) - at > long and (found := _SAFE.search(text, at + long)):
        out.append(text[at:found.start()])
        at = found.end()
    return [*out, text[at:]]


def whole_of(fragment: Fragment, sizes) -> Fragment:
    """The fragment of a whole text, all of it closed: a text begins behind a cut and ends with one."""
    return combine(Fragment(True, *EMPTY[1:]), fragment, sizes)


PAIRS = pa.list_(pa.int64())
#: A block: its documents, its distinct pairs, and per document how many of them it holds, which ones and how often.
BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", PAIRS), ("n_a", PAIRS), ("n_b", PAIRS), ("n_groups", PAIRS), ("n_links", PAIRS), ("groups", pa.list_(pa.string())),
                    ("n_pairs", PAIRS), ("pairs", pa.binary()), ("which", pa.binary()), ("times", pa.binary())])
BLOCKS_SQL = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, n_pairs array<long>, "
              "pairs binary, which binary, times binary")
OPEN = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("fine", pa.bool_()), ("n_a", pa.int64()), ("cut", pa.bool_()),
                  ("head_a", PAIRS), ("head_b", PAIRS), ("tail_a", PAIRS), ("tail_b", PAIRS), ("closed", pa.binary()), ("groups", pa.int64()), ("pairs", PAIRS), ("times", PAIRS)])
OPEN_SQL = ("row long, doc_id long, part long, fine boolean, n_a long, cut boolean, head_a array<long>, head_b array<long>, tail_a array<long>, tail_b array<long>, "
            "closed binary, groups long, pairs array<long>, times array<long>")


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 to the 32nd in byte planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones in order, and how often each occurs."""
    pairs = np.sort(pairs)
    at = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else NO_IDS
    return pairs[at], np.diff(np.r_[at, len(pairs)])


class _Block:
    """Documents until they have ``BLOCK`` links."""

    def __init__(self, number: int, digest: bool):
        self.number, self.digest, self.rows, self.pairs, self.times, self.links = number, digest, [], [], [], 0

    def add(self, doc_id, entry: Entry | None) -> bool:
        """Whether the block is full with this document."""
        pairs, times = _distinct(np.frombuffer(entry[1], np.int64) if entry else NO_IDS)
        return self.put(doc_id, entry[0] if entry else None, entry[2] if entry else 0, pairs, times)

    def put(self, doc_id, closed: bytes | None, n_a: int, pairs: np.ndarray, times: np.ndarray) -> bool:
        written, groups, links = "", 0, int(times.sum())
        if closed:
            written, groups = hashlib.sha256(closed).hexdigest() if self.digest else closed.decode(), closed.count(b";") + 1
        # of a group with m and n tokens, m + n - 1 pairs overlap
        self.rows.append((doc_id, n_a, links + groups - n_a, groups, links, written, len(pairs)))
        self.pairs.append(pairs)
        self.times.append(times)
        self.links += links + 100
        return self.links >= BLOCK

    def batch(self) -> pa.RecordBatch:
        pairs = np.concatenate([*self.pairs, NO_IDS])
        distinct, which = np.unique(pairs, return_inverse=True)
        ends = np.cumsum([len(p) for p in self.pairs])
        gaps = np.diff(which, prepend=0)
        begins = (ends - [len(p) for p in self.pairs])[[len(p) > 0 for p in self.pairs]]
        gaps[begins] = which[begins]
        columns = list(zip(*self.rows))
        code = np.concatenate([distinct // SECOND, distinct % SECOND])
        values = [self.number, *map(list, columns), _packed(code), _packed(gaps), _packed(np.concatenate([*self.times, NO_IDS]))]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, BLOCKS.types)], schema=BLOCKS)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its distinct pairs, how many pairs each document holds, which ones, and how often."""
    code, n, which = _unpacked(row["pairs"]), np.array(row["n_pairs"], np.int64), _unpacked(row["which"])
    sums = np.cumsum(which)
    begins = (np.cumsum(n) - n)[n > 0]
    base = np.where(begins > 0, sums[begins - 1], 0) if len(begins) else NO_IDS
    return code[:len(code) // 2] * SECOND + code[len(code) // 2:], n, sums - np.repeat(base, n[n > 0]), _unpacked(row["times"])


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _align(first: str, second: str, digest: bool):
    """Texts that stay whole, in blocks."""
    def run(batches):
        from pyspark import TaskContext

        kinds = tokens(first, second)
        block = _Block(TaskContext.get().partitionId() << 32, digest)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if block.add(doc_id, kinds.encode(text) if text else None):
                    yield block.batch()
                    block = _Block(block.number + 1, digest)
        if block.rows:
            yield block.batch()
    return run


def _divide(long: int):
    """Long texts as parts, a row each."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("text", pa.string())])

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for n, part in enumerate(parts(text.as_py(), long)):
                    yield _batch([(row, doc_id, n, part)], schema)
                row += 1
    return run


def _open(row, doc_id, part, fine, n_a, f: Fragment) -> tuple:
    return row, doc_id, part, fine, n_a, f.cut, *f.head, *f.tail, f.closed, f.groups, f.pairs, f.times


def _align_parts(first: str, second: str):
    """Parts of long texts as one fragment each: all of a part is closed, its first group is open to what stands before."""
    def run(batches):
        kinds = tokens(first, second)
        for batch in batches:
            for row, doc_id, part, text in zip(*(batch.column(n).to_pylist() for n in range(4))):
                entry = kinds.encode(text)
                f = Fragment(True, (NO_IDS, NO_IDS), (NO_IDS, NO_IDS), entry[0], entry[0].count(b";") + 1, *_distinct(np.frombuffer(entry[1], np.int64))) if entry else EMPTY
                yield _batch([_open(row, doc_id, part, entry is not None, entry[2] if entry else 0, f)], OPEN)
    return run


def _fragment(r: dict) -> Fragment:
    ids = [np.array(r[n], np.int64) for n in ("head_a", "head_b", "tail_a", "tail_b", "pairs", "times")]
    return Fragment(r["cut"], tuple(ids[:2]), tuple(ids[2:4]), r["closed"], r["groups"], *ids[4:])


def _join_parts(first: str, second: str):
    """Neighbouring fragments of a long text as one."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        f, r = fold(list(map(_fragment, rows)), tokens(first, second).sizes), rows[0]
        return pa.Table.from_batches([_batch([_open(r["row"], r["doc_id"], r["part"] // FAN, all(x["fine"] for x in rows), sum(x["n_a"] for x in rows), f)], OPEN)])
    return run


def _close(first: str, second: str, digest: bool):
    """Long texts that have become one fragment; each is a block of its own."""
    def run(batches):
        sizes = tokens(first, second).sizes
        for batch in batches:
            for r in batch.to_pylist():
                block, f = _Block(-1 - r["row"], digest), whole_of(_fragment(r), sizes) if r["fine"] else EMPTY
                block.put(r["doc_id"], f.closed if r["fine"] else None, r["n_a"] if r["fine"] else 0, f.pairs, f.times)
                yield block.batch()
    return run


def align_blocks(documents: DataFrame, first: str, second: str, digest: bool = False, long: int = LONG) -> DataFrame:
    """All rows of ``documents`` (doc_id, text) in blocks, written to the shared folder; see :func:`align`."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = texts.where(F.coalesce(F.length("text") <= long, F.lit(True))).mapInArrow(_align(first, second, digest), BLOCKS_SQL)
    spark = documents.sparkSession
    divided = (texts.where(F.length("text") > long).mapInArrow(_divide(long), "row long, doc_id long, part long, text string")
               .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row", "part"))
    opened = cut(divided.mapInArrow(_align_parts(first, second), OPEN_SQL))
    last = opened.agg(F.max("part")).first()[0]
    if last is None:
        return stored(short)
    while last > 0:
        opened = cut(opened.groupBy("row", F.floor(F.col("part") / FAN).alias("of")).applyInArrow(_join_parts(first, second), OPEN_SQL))
        last //= FAN
    return stored(short.unionByName(opened.mapInArrow(_close(first, second, digest), BLOCKS_SQL)))


def align(documents: DataFrame, first: str, second: str, long: int = LONG) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, a, b, times`` for every row of ``documents`` (doc_id, text).

    ``groups`` lists the groups of ids in order, ``a1,a2|b1;a3|b2``; ``a``, ``b`` and ``times`` are the distinct linked pairs and how often each
    occurs.  ``first`` is the file of a byte-level tokenizer, ``second`` a sentencepiece model that puts a
    space in front; both see a space and the text, in which strings of special tokens are plain text.  Texts that are null, empty or not
    given back byte for byte by either have no tokens: zeros, an empty string, empty lists.  Every row counts, also
    repeated ones and those with a null id.
    """
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                distinct, n, which, times = _read(row)
                ends = np.cumsum(n)
                for k, (s, t) in enumerate(zip(ends - n, ends)):
                    pairs = distinct[which[s:t]]
                    values = (*(row[c][k] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")), pairs // SECOND, pairs % SECOND, times[s:t])
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if c == 5 else PAIRS if c > 5 else pa.int64()) for c, v in enumerate(values)],
                                                     names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "times"])

    columns = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<long>, b array<long>, times array<long>"
    return align_blocks(documents, first, second, long=long).mapInArrow(run, columns)


def _held(batches):
    """Distinct pairs of each block with the number of its documents that hold them."""
    for batch in batches:
        for row in batch.to_pylist():
            distinct, _, which, _ = _read(row)
            docs = np.bincount(which, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), row["block"])), pa.array(distinct), pa.array(docs)], names=["block", "pair", "docs"])


WEIGHED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _weigh(blocks: pa.Table, known: pa.Table) -> pa.Table:
    """Links of a block's documents summed up with the counts of the block's pairs."""
    (row,) = blocks.to_pylist()
    distinct, n, which, times = _read(row)
    order = np.argsort(known.column("pair").to_numpy())  # the same pairs, in the same order
    count, best = known.column("count").to_numpy()[order], known.column("best").to_numpy(zero_copy_only=False)[order]
    ends = np.cumsum(n)
    sums = [np.concatenate([[0], np.cumsum(times * v[which])]) if len(which) else np.zeros(1, np.int64) for v in (best, count)]
    columns = [*(row[c] for c in WEIGHED[:5]), *(s[ends] - s[ends - n] for s in sums), row["groups"]]
    return pa.table({c: pa.array(v, pa.string() if c == "groups_sha256" else pa.int64()) for c, v in zip(WEIGHED, columns)})


def report(documents: DataFrame, first: str, second: str, long: int = LONG) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``documents``; see :func:`align`.

    A pair's count is the number of rows that hold it linked; ``n_best`` counts the links whose pair has its first id's highest count, ties
    included, and ``count_sum`` adds the counts of all links.
    """
    blocks = align_blocks(documents, first, second, digest=True, long=long)
    held = stored(blocks.select(*BLOCKS.names).mapInArrow(_held, "block long, pair long, docs long"))
    counts = cut(held.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("id", F.shiftright("pair", 24)))
    highest = counts.groupBy("id").agg(F.max("count").alias("highest"))
    counts = counts.join(highest, "id").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    known = held.select("block", "pair").join(counts, "pair").select("block", "pair", "count", "best")
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_weigh, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
