"""Best-fit packing of documents into sequences of a fixed number of tokens, improved by exchanges between sequences.

Documents become pieces (only longer ones are cut).  Full pieces are sequences of their own.  The others are dealt
evenly into shards of a bounded number of pieces; each shard is packed best fit first and then searched locally.  The
pieces of all sequences that are still underfull are dealt again and packed together, until that no longer helps.
No task holds more than a shard, and no piece is dropped or capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostwatch.llm.common import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"

#: Pieces of a shard at most; a task holds that many rows of seven numbers.
SHARD_PIECES = 16_384
#: Sequence numbers: the round in the highest bits, then the task, then a count inside the task.
_ROUND, _TASK = 1 << 56, 1 << 28


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and ``sequence_id`` of full pieces.

    A document has the ids of its whole text and ``end_id``.  Longer ones are cut into pieces of ``capacity``, of which
    the first may be shorter.  Null texts count as empty: one piece of one token.  Rows with a null or repeated
    ``doc_id`` are documents like any other.
    """
    def run(batches):
        from pyspark import TaskContext

        from hostwatch.llm.tokens import crc32, encoder

        encode, end, full = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes(), 0
        base = 15 * (_ROUND >> 1) + TaskContext.get().partitionId() * _TASK
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(encode(text.as_py() or "") + end)
                n = len(ids) // 4
                begin, stop, piece = 0, n % capacity or capacity, 0
                stop = min(stop, n)
                while begin < n:
                    whole = stop - begin == capacity
                    out.append((doc, piece, begin, stop - begin, crc32(ids[4 * begin:4 * stop]), base + full if whole else None))
                    full += whole
                    begin, stop, piece = stop, stop + capacity, piece + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"])

    return docs.select("doc_id", "text").mapInArrow(run, f"{PIECES}, sequence_id long")


class Bins:
    """Bins of one shard, by item numbers: best fit over decreasing sizes, then exchanges."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bin = np.empty(len(sizes), np.int64)
        by_free: dict[int, list[int]] = {}
        frees = 0  # bit f is set while a bin with f free tokens is listed
        free: list[int] = []
        for i in np.argsort(-sizes, kind="stable").tolist():
            size = int(sizes[i])
            fitting = frees >> size
            if fitting:
                f = size + (fitting & -fitting).bit_length() - 1
                b = by_free[f].pop()
                if not by_free[f]:
                    frees ^= 1 << f
            else:
                f, b = capacity, len(free)
                free.append(capacity)
            self.bin[i] = b
            free[b] = f = f - size
            if f:
                by_free.setdefault(f, []).append(b)
                frees |= 1 << f
        self.free = np.array(free, np.int64)

    def improve(self) -> None:
        """Exchange items between underfull bins while the sum of squared fills grows; the emptiest bins give first.

        A giving bin moves an item, swaps a larger one for a smaller one, or gives two for one, always with a bin that is
        at least as full and fills that bin the most.  Each exchange raises the sum of squares, so the search ends.
        """
        under = np.flatnonzero(np.isin(self.bin, np.flatnonzero(self.free)))
        size, at = self.sizes[under], self.bin[under].copy()
        givers = np.flatnonzero(self.free)
        for giver in givers[np.argsort(-self.free[givers], kind="stable")].tolist():
            spare = self.free[self.free < self.capacity].sum()
            if spare < self.capacity:  # not even all free room together holds one bin
                break
            while (mine := np.flatnonzero(at == giver)).size and self._exchange(giver, mine, size, at):
                pass
        self.bin[under] = at

    def _exchange(self, giver: int, mine: np.ndarray, size: np.ndarray, at: np.ndarray) -> bool:
        free = self.free
        room = np.where((free <= free[giver]) & (free > 0), free, 0)
        room[giver] = 0
        open_bins = np.flatnonzero(room)
        if not open_bins.size:
            return False
        tightest = np.argsort(room[open_bins], kind="stable")
        bins, rooms = open_bins[tightest], room[open_bins][tightest]
        k = np.searchsorted(rooms, size[mine])  # moves: the tightest bin that has the room
        if (fits := np.flatnonzero(k < len(rooms))).size:
            best = fits[np.argmax(size[mine][fits])]
            return self._apply(giver, int(bins[k[best]]), [mine[best]], [], size, at)
        theirs = np.flatnonzero(room[at] > 0)
        values, first = np.unique(size[mine], return_index=True)
        given = [(int(v), [mine[i]]) for v, i in zip(values, first)]
        seen = set(values.tolist())
        for i, u in enumerate(values.tolist()):
            for v in values[i:].tolist():
                if u + v in seen or u + v > self.capacity:
                    continue
                pair = mine[size[mine] == u][:1].tolist() + mine[size[mine] == v][-1:].tolist()
                if pair[0] != pair[1]:
                    seen.add(u + v)
                    given.append((u + v, pair))
        gain_most, chosen = 0, None
        room_of, theirs_size = room[at[theirs]], size[theirs]
        for total, items in given:
            gain = total - theirs_size
            gain[(gain <= 0) | (gain > room_of)] = 0
            if gain.size and (best := int(gain.argmax())) >= 0 and gain[best] > gain_most:
                gain_most, chosen = int(gain[best]), (items, theirs[best])
        if chosen is None:
            return False
        return self._apply(giver, int(at[chosen[1]]), chosen[0], [chosen[1]], size, at)

    def _apply(self, giver: int, taker: int, give: list, get: list, size: np.ndarray, at: np.ndarray) -> bool:
        moved = int(size[give].sum() - size[get].sum())
        at[give], at[get] = taker, giver
        self.free[taker] -= moved
        self.free[giver] += moved
        return True


def _pack_shards(pieces: DataFrame, shards: int, capacity: int, turn: int) -> DataFrame:
    """Pack the pieces of each of ``shards`` equal shares; ``room`` is what their sequence has left."""
    def run(batches):
        from pyspark import TaskContext

        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        sizes = t.column("length").to_numpy().astype(np.int64)
        bins = Bins(sizes, capacity)
        bins.improve()
        order = np.lexsort((np.arange(len(sizes)), bins.bin))
        ends = np.cumsum(sizes[order])
        starts = ends - sizes[order]
        b = bins.bin[order]
        new = np.r_[True, b[1:] != b[:-1]]
        offset = starts - np.maximum.accumulate(np.where(new, starts, 0))
        base = turn * _ROUND + TaskContext.get().partitionId() * _TASK
        t = t.take(order).select(["doc_id", "piece", "start", "length", "ids_crc32"])
        for name, values in (("sequence_id", base + b), ("offset", offset), ("room", bins.free[b])):
            t = t.append_column(name, pa.array(values, pa.int64()))
        yield from t.to_batches(max_chunksize=8192)

    return pieces.select(*[c.split()[0] for c in PIECES.split(", ")]).repartition(shards).mapInArrow(run, f"{PACKED}, room long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack all ``docs`` (doc_id, text; more columns are ignored) into as few sequences of ``capacity`` tokens as it can.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``; see :func:`cut_pieces`.  Offsets
    of a sequence are gapless from 0.  An empty table gives no rows; documents of equal length may trade places.
    """
    pieces = cut(cut_pieces(docs, tokenizer, capacity, end_id))
    done = [pieces.where("sequence_id IS NOT NULL").withColumn("offset", F.lit(0).cast("long"))]
    left, turn = pieces.where("sequence_id IS NULL"), 0
    count = left.count()
    while count:
        shards = -(-count // shard_pieces)
        packed = cut(_pack_shards(left, shards, capacity, turn))
        again = packed.where("room > 0").count() if shards > 1 else 0
        if again == 0 or again > 0.7 * count or turn == 6:  # one shard, all full, or little to gain from dealing again
            done.append(packed.drop("room"))
            break
        done.append(packed.where("room = 0").drop("room"))
        left, count, turn = packed.where("room > 0"), again, turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
