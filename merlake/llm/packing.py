"""Best-fit packing of token sequences, improved by a swap-based local search.

Documents are tokenised once, cut into pieces of at most ``capacity`` tokens, and only the
pieces' lengths are packed.  Chunks of bounded size are packed side by side: best fit by
falling length, then a local search over the bins that are not full.  It moves pieces and
exchanges one for one or two for one whenever that raises the sum of squared fills, which
drains the emptiest bins into the fuller ones until they are gone.  The underfull bins of
all chunks meet in further rounds of chunks of the same size.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, measure


def load_ranks(spark, path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def load_added(path: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file, which it matches in raw text, with their ids."""
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)["added_tokens"]
    added = {r["content"]: r["id"] for r in rows}
    if any(r["single_word"] or r["lstrip"] or r["rstrip"] or r["normalized"] for r in rows) or any(a != b and a in b for a in added for b in added):
        raise ValueError("only added tokens that match literally and do not hold one another")
    return added


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole ones of ``capacity`` after a first, shorter one."""
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, min(capacity, (first or capacity) if s == 0 else capacity)) for s in starts]


def pieces(docs: DataFrame, ranks: dict[bytes, int], pattern: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's pieces.

    The vocabulary is byte-level BPE.  A text is split at the strings of ``added``, which get
    their ids; strings of other special tokens are ordinary text.  A null text is empty and
    gives a piece with the end id alone.  Repeated rows give their
    pieces each time; null ids stay null; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=shared.value, special_tokens=added or {})
        end = np.array([end_id], "<u4")
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = encoding.encode_to_numpy(text.as_py() or "", allowed_special="all", disallowed_special=())
                ids = np.concatenate([found.astype("<u4", copy=False), end])
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(own.tobytes()), own.tolist() if with_ids else None), strict=False):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each to the fullest bin with room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []  # the rooms that some bin has, sorted
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - n
        if left:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, sweeps: int = 16) -> list[list[int]]:
    """Raise the sum of squared fills by moves and exchanges between underfull bins.

    A step takes one or two pieces from a bin (the giver) and gives it shorter ones back, so
    that the room of another (the taker) shrinks: one piece for none, one for one, or two for
    one either way.  Steps that fill the taker come first, then those that gain most, with a
    taker that is no emptier.  Every underfull bin gives, the emptiest first, in at most
    ``sweeps`` sweeps, fewer if one finds no step.
    """
    search = _Search(capacity, lengths)
    full = []
    for b in bins:
        if b and sum(lengths[i] for i in b) == capacity:
            full.append(b)
        elif b:
            search.add(list(b))
    for _ in range(sweeps):
        if not search.sweep():
            break
    return full + [b for b in search.bins if b]


class _Offers:
    """What bins would give back: which have it, by its sum and their room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.some = np.zeros((capacity, capacity), bool)
        self.bins: dict[int, dict[int, None]] = {}

    def put(self, sums: Iterable[int], room: int, b: int) -> None:
        for m in sums:
            self.bins.setdefault(m * self.capacity + room, {})[b] = None
            self.some[m, room] = True

    def take(self, sums: Iterable[int], room: int, b: int) -> None:
        for m in sums:
            own = self.bins[m * self.capacity + room]
            del own[b]
            if not own:
                del self.bins[m * self.capacity + room]
                self.some[m, room] = False

    def first(self, m: int, room: int) -> int:
        return next(iter(self.bins[m * self.capacity + room]))


class _Waiting(_Offers):
    """Those of bins that have yet to give in this sweep, with the largest room for each sum."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.top = np.full(capacity, -1)

    def put(self, sums: Iterable[int], room: int, b: int) -> None:
        super().put(sums, room, b)
        for m in sums:
            self.top[m] = max(self.top[m], room)

    def take(self, sums: Iterable[int], room: int, b: int) -> None:
        super().take(sums, room, b)
        for m in sums:
            if self.top[m] == room and not self.some[m, room]:
                rooms = np.flatnonzero(self.some[m, :room])
                self.top[m] = rooms[-1] if len(rooms) else -1


class _Search:
    """Underfull bins, with tables of their single pieces (or none: 0) and of their pairs."""

    def __init__(self, capacity: int, lengths: list[int]):
        self.capacity, self.lengths = capacity, lengths
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.sums: list[tuple[dict[int, list[int]], dict[int, list[int]]]] = []
        self.all = (_Offers(capacity), _Offers(capacity))
        self.waiting = (_Waiting(capacity), _Waiting(capacity))
        self.waits: list[bool] = []

    def _sums(self, b: int) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
        """The sums of single pieces (and of none) and of pairs, each with pieces that have it."""
        one: dict[int, list[int]] = {}
        for i in self.bins[b]:
            one.setdefault(self.lengths[i], []).append(i)
        two: dict[int, list[int]] = {}
        kinds = sorted(one)
        for x, m in enumerate(kinds):
            for n in kinds[x:]:
                if m != n or len(one[m]) > 1:
                    two.setdefault(m + n, [one[m][0], one[n][-1]])
        return {0: []} | {m: own[:1] for m, own in one.items()}, two

    def add(self, members: list[int]) -> None:
        self.bins.append(members)
        self.room.append(self.capacity - sum(self.lengths[i] for i in members))
        self.sums.append(({}, {}))
        self.waits.append(False)
        self._enter(len(self.bins) - 1, False)

    def _enter(self, b: int, waits: bool) -> None:
        self.sums[b], self.waits[b] = self._sums(b), waits
        for k in (0, 1):
            self.all[k].put(self.sums[b][k], self.room[b], b)
            if waits:
                self.waiting[k].put(self.sums[b][k], self.room[b], b)

    def _leave(self, b: int) -> None:
        for k in (0, 1):
            self.all[k].take(self.sums[b][k], self.room[b], b)
            if self.waits[b]:
                self.waiting[k].take(self.sums[b][k], self.room[b], b)

    def sweep(self) -> bool:
        changed = False
        order = sorted((b for b in range(len(self.bins)) if self.bins[b] and self.room[b]), key=lambda b: -self.room[b])
        for b in order:
            self._leave(b)
            self._enter(b, True)
        for giver in order:
            if not self.room[giver]:
                continue  # it has been filled
            self._leave(giver)
            while self.bins[giver] and (step := self._step(giver)):
                taker, give, back = step
                self._leave(taker)
                gain = sum(self.lengths[i] for i in give) - sum(self.lengths[i] for i in back)
                self.bins[giver] = [i for i in self.bins[giver] if i not in give] + back
                self.bins[taker] = [i for i in self.bins[taker] if i not in back] + give
                self.room[giver] += gain
                self.room[taker] -= gain
                if self.room[taker]:
                    self._enter(taker, self.waits[taker])
                changed = True
            if self.bins[giver]:
                self._enter(giver, False)
        return changed

    def _step(self, giver: int) -> tuple[int, list[int], list[int]] | None:
        """(taker, pieces to give, pieces to get back): a step that fills a taker, else the one that gains most."""
        one, two = self._sums(giver)
        offers = [(x, give, k) for own, k in ((one, 0), (two, 0), (one, 1)) for x, give in own.items() if x]
        offers.sort(key=lambda o: -o[0])
        best, found = 0, None
        for x, give, k in offers:
            back = np.arange(max(0, x - self.capacity + 1), min(x, self.capacity))
            gain = x - back
            if (filled := self.all[k].some[back, gain]).any():
                at = int(filled.argmax())
                return self._with(int(back[at]), int(gain[at]), give, k, self.all)
            if x > best and (able := self.waiting[k].top[back] >= gain).any() and gain[at := int(able.argmax())] > best:
                best, found = int(gain[at]), (int(back[at]), int(self.waiting[k].top[back[at]]), give, k, self.waiting)
        return self._with(*found) if found else None

    def _with(self, back: int, room: int, give: list[int], k: int, table: tuple[_Offers, _Offers]) -> tuple[int, list[int], list[int]]:
        taker = table[k].first(back, room)
        return taker, give, self.sums[taker][k][back]


def _pack(part: pd.DataFrame, capacity: int, chunk: int) -> pd.DataFrame:
    """part: the loose bins of one chunk; returns them packed anew, with new bin numbers."""
    items = part.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
    lengths = items["length"].tolist()
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    bin_of, offset, fill = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for b, members in enumerate(bins):
        at = 0
        for i in members:
            bin_of[i], offset[i] = b, at
            at += lengths[i]
        for i in members:
            fill[i] = at
    return items.assign(bin=bin_of, offset=offset, fill=fill, chunk=chunk)


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, bin long, offset long, fill long"


def pack(piece_rows: DataFrame, capacity: int = 1024, chunk_rows: int = 40_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces.

    Pieces as long as the capacity have a sequence of their own.  The others are dealt at
    random into chunks of about ``chunk_rows``; the pieces of bins that stay underfull are
    dealt into chunks of that size again, as long as their number falls by an eighth.  So no
    task holds more than about ``chunk_rows`` rows, whatever the lengths are, and only
    the last round's chunks keep underfull bins.  An empty table gives no rows.
    """
    rows = materialise(piece_rows, "pieces", loose=F.sum((F.col("length") < capacity).cast("long")))
    chunks = max(1, math.ceil(measure(rows, "loose") / chunk_rows))
    dealt = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(chunks))
    loose = rows.where(F.col("length") < capacity).withColumn("chunk", dealt)
    whole = rows.where(F.col("length") >= capacity).withColumn("chunk", F.lit(-1).cast("long"))
    name = lambda level: F.lit(level << 58) + F.shiftleft(F.col("chunk"), 32) + F.col("bin")
    done = [whole.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _pack(part[["doc_id", "piece", "start", "length", "ids_crc32"]], capacity, int(key[0]))

    level = 0
    while True:
        packed = materialise(loose.groupBy("chunk").applyInPandas(run, _PACKED), "packed", open=F.sum((F.col("fill") < capacity).cast("long")))
        more = max(1, math.ceil(measure(packed, "open") / chunk_rows))
        last = chunks == 1 or 8 * more > 7 * chunks
        final = packed if last else packed.where(F.col("fill") == capacity)
        done.append(final.select("doc_id", "piece", "start", "length", "ids_crc32", name(level).alias("sequence_id"), "offset"))
        if last:
            break
        chunks, before = more, level
        again = F.pmod(F.xxhash64(name(before)), F.lit(chunks)).alias("chunk")
        loose = packed.where(F.col("fill") < capacity).select("doc_id", "piece", "start", "length", "ids_crc32", again)
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
