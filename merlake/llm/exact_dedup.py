"""Exact deduplication with counting quotient filters.

Every partition builds a counting quotient filter of the 64-bit fingerprints of its
normalised texts.  A fingerprint is split into a quotient (the high bits, which name its
home slot) and a remainder (the low bits, which the slot table holds, sorted within the run
of the quotient), so the filter holds whole fingerprints and filters merge without loss:
their sorted remainders are merged and the counts of equal ones added.  Only rows whose
fingerprint is counted more than once are routed to the byte verification, which groups them
by the normalised bytes themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import WHITE, join_hot, materialise, measure, parts

_WHITE_BYTES = WHITE.encode()
#: The largest routing bitmap, in bits: 32 MB.  More repeated fingerprints than fill an eighth
#: of it are joined instead.
ROUTE_BITS = 1 << 28

_OCCUPIED, _CONTINUED, _SHIFTED, _USED = 1, 2, 4, 8


class CountingQuotientFilter:
    """Fingerprints of ``bits`` bits with their counts, in a table of slots.

    The high ``quotient_bits`` of a fingerprint are its home slot, the others its remainder.
    Remainders of one home are a run of neighbouring slots in sorted order; a run that
    cannot start at its home is shifted to the right.  Three bits a slot tell runs apart:
    occupied (some run has its home here), continued (the slot goes on with the run of the
    one before), shifted (the remainder isn't at home).  The table is not circular: it has
    spare slots at its end.
    """

    def __init__(self, quotient_bits: int, bits: int = 64):
        if not 1 <= quotient_bits < bits <= 64:
            raise ValueError("needs 1 <= quotient_bits < bits <= 64")
        self.quotient_bits, self.bits = quotient_bits, bits
        self.remainder_bits = bits - quotient_bits
        self._fill(np.empty(0, np.uint64), np.empty(0, np.int64))

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int = 64) -> CountingQuotientFilter:
        """A filter of sorted distinct fingerprints, at most three quarters full."""
        out = cls(min(bits - 1, max(1, math.ceil(math.log2(max(1, len(fingerprints)) / 0.75)))), bits)
        out._fill(fingerprints, counts)
        return out

    def _fill(self, fingerprints: np.ndarray, counts: np.ndarray) -> None:
        home = (fingerprints >> np.uint64(self.remainder_bits)).astype(np.int64)
        order = np.arange(len(home))
        slot = order + np.maximum.accumulate(home - order) if len(home) else home
        size = max(1 << self.quotient_bits, int(slot[-1]) + 1 if len(slot) else 0)
        self.flags = np.zeros(size, np.uint8)
        self.remainders = np.zeros(size, np.uint64)
        self.counts = np.zeros(size, np.int64)
        self.flags[home] |= _OCCUPIED
        self.flags[slot] |= _USED
        self.flags[slot[1:][home[1:] == home[:-1]]] |= _CONTINUED
        self.flags[slot[slot != home]] |= _SHIFTED
        self.remainders[slot] = fingerprints & np.uint64((1 << self.remainder_bits) - 1)
        self.counts[slot] = counts

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, sorted, and their counts, read from the slots.

        Runs stand in the order of their homes, so the k-th run is that of the k-th occupied slot.
        """
        used = np.flatnonzero(self.flags & _USED)
        run = np.cumsum(self.flags[used] & _CONTINUED == 0) - 1
        home = np.flatnonzero(self.flags & _OCCUPIED)[run].astype(np.uint64)
        return (home << np.uint64(self.remainder_bits)) | self.remainders[used], self.counts[used]

    def count(self, fingerprint: int) -> int:
        """How often the fingerprint was inserted, by walking its cluster."""
        home, want = fingerprint >> self.remainder_bits, fingerprint & ((1 << self.remainder_bits) - 1)
        if not self.flags[home] & _OCCUPIED:
            return 0
        at = home
        while self.flags[at] & _SHIFTED:
            at -= 1
        for _ in range(int((self.flags[at:home] & _OCCUPIED != 0).sum())):  # the runs before this one
            at += 1
            while self.flags[at] & _CONTINUED:
                at += 1
        while True:
            if self.remainders[at] == want:
                return int(self.counts[at])
            at += 1
            if at == len(self.flags) or not self.flags[at] & _CONTINUED:
                return 0

    @classmethod
    def merged(cls, filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
        """All entries of filters of equally wide fingerprints, merged in one pass over their sorted entries."""
        filters = list(filters)
        if len({f.bits for f in filters}) > 1:
            raise ValueError("filters of fingerprints of different widths don't merge")
        each = [f.entries() for f in filters]
        prints, counts = (np.concatenate(x) for x in zip(*each, strict=True))
        return cls.of(*_summed(prints, counts), filters[0].bits)

    def to_bytes(self) -> bytes:
        """Flags of all slots, then remainders (as many bytes as they need) and counts of those in use."""
        used = self.flags & _USED != 0
        width = -(-self.remainder_bits // 8)
        remainders = self.remainders[used].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        counts = self.counts[used]
        small = np.minimum(counts, 255).astype(np.uint8)
        head = np.array([self.quotient_bits, self.bits, len(self.flags), len(counts)], "<i8").tobytes()
        return head + self.flags.tobytes() + remainders + small.tobytes() + counts[small == 255].astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        quotient_bits, bits, size, n = np.frombuffer(data, "<i8", 4).tolist()
        out = cls.__new__(cls)
        out.quotient_bits, out.bits, out.remainder_bits = quotient_bits, bits, bits - quotient_bits
        width, at = -(-out.remainder_bits // 8), 32
        out.flags = np.frombuffer(data, np.uint8, size, at)
        at += size
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        small = np.frombuffer(data, np.uint8, n, at)
        counts = small.astype(np.int64)
        counts[small == 255] = np.frombuffer(data, "<i8", offset=at + n)
        used = np.flatnonzero(out.flags & _USED)
        out.remainders, out.counts = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        out.remainders[used], out.counts[used] = wide.view("<u8")[:, 0], counts
        return out

    def blocks(self, block_bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """A filter for each value of the highest bits, which its fingerprints then lack."""
        prints, counts = self.entries()
        rest = self.bits - block_bits
        block = (prints >> np.uint64(rest)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:], strict=False) if len(block) else ():
            yield int(block[a]), CountingQuotientFilter.of(prints[a:b] & np.uint64((1 << rest) - 1), counts[a:b], rest)


class FilterBuilder:
    """Gathers fingerprints and merges them into a filter when as many more have come as it has."""

    def __init__(self) -> None:
        self.filter = CountingQuotientFilter(1)
        self.waiting: list[np.ndarray] = []
        self.n_waiting, self.n_merged = 0, 0

    def insert_all(self, fingerprints: np.ndarray) -> None:
        self.waiting.append(fingerprints.astype(np.uint64))
        self.n_waiting += len(fingerprints)
        if self.n_waiting > max(1 << 16, self.n_merged):
            self._merge()

    def _merge(self) -> None:
        new = CountingQuotientFilter.of(*_summed(np.concatenate(self.waiting), np.ones(self.n_waiting, np.int64)))
        self.filter = CountingQuotientFilter.merged([self.filter, new])
        self.waiting, self.n_waiting, self.n_merged = [], 0, int((self.filter.counts > 0).sum())

    def finish(self) -> CountingQuotientFilter:
        if self.n_waiting:
            self._merge()
        return self.filter


def _summed(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct fingerprints, sorted, with the sums of their counts."""
    if not len(prints):
        return prints, counts
    order = np.argsort(prints, kind="stable")  # merges what is sorted in pieces
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[first], np.add.reduceat(counts, first)


def normalise(text: str | None) -> bytes:
    """The text's UTF-8 without the six white-space characters; null is empty."""
    return (text or "").encode().translate(None, _WHITE_BYTES)


def _fingerprint(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chars, prints, shas = [], [], []
        for text in batch.column(1):
            text = text.as_py()
            data = normalise(text)
            chars.append(len(text or ""))
            prints.append(_signed(_fingerprint(data)))
            shas.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(prints, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "chars", "fp", "text_sha256"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chars, fp, text_sha256) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_prints, "doc_id long, chars long, fp long, text_sha256 string")


def repeated(prints: DataFrame, n_rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that are counted more than once in all partitions.

    Filters are split by the highest bits and merged block by block.  A block has about
    2**18 fingerprints however large the input is, or fewer where there are more tasks.
    """
    block_bits = max(1, math.ceil(math.log2(max(parts(prints.sparkSession), n_rows / 2**18))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FilterBuilder()
        for batch in batches:
            own.insert_all(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        rows = [(k, f.to_bytes()) for k, f in own.finish().blocks(block_bits)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "slots"])

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        whole, counts = CountingQuotientFilter.merged(map(CountingQuotientFilter.from_bytes, part.slots)).entries()
        whole = whole | np.uint64(int(key[0]) << (64 - block_bits))
        return pd.DataFrame({"fp": whole[counts > 1].view(np.int64), "n": counts[counts > 1]})

    filters = prints.select("fp").mapInArrow(build, "block long, slots binary")
    return filters.groupBy("block").applyInPandas(merge, "fp long, n long")


def _route_bitmap(fps: DataFrame, bits: int) -> bytes:
    """A bitmap that has the bit of every given fingerprint set."""
    slot = F.col("fp").bitwiseAND(bits - 1)
    rows = fps.groupBy(F.shiftright(slot, 15).alias("b")).agg(F.bitmap_construct_agg(slot.bitwiseAND(32767)).alias("m"))
    out = bytearray(max(4096, bits // 8))
    for row in rows.toLocalIterator():
        out[row.b * 4096 : row.b * 4096 + 4096] = row.m
    return bytes(out)


def _routed(rows: DataFrame, twice: DataFrame, text_at: int) -> tuple[DataFrame | None, DataFrame]:
    """(row) of rows that surely repeat no fingerprint of ``twice``, and (row, fp, sha, chars, data) of the others.

    ``rows`` has one column, the struct row, whose field ``text_at`` is the text.  A bitmap,
    sized by the number of repeated fingerprints, routes the rows where they are read, so the
    others are never shuffled.  With more fingerprints than it can hold, none are routed that
    way (the first result is None) and a join with the fingerprints does it.
    """
    n = measure(twice)
    bits = 1 << max(15, (32 * n).bit_length()) if 8 * n <= ROUTE_BITS else 0
    bits = min(bits, ROUTE_BITS)
    shared = rows.sparkSession.sparkContext.broadcast(_route_bitmap(twice, bits)) if bits else None

    def run(want: bool):
        def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks = shared.value if bits else None
            for batch in batches:
                keep, found = [], []
                for text in batch.column(0).field(text_at):
                    text = text.as_py()
                    data = normalise(text)
                    fp = _fingerprint(data)
                    slot = fp & (bits - 1)
                    keep.append(not bits or bool(marks[slot >> 3] >> (slot & 7) & 1) == want)
                    if want and keep[-1]:
                        found.append((_signed(fp), hashlib.sha256(data).hexdigest(), len(text or ""), data))
                own = batch.column(0).filter(pa.array(keep, pa.bool_()))
                more = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.binary()))] if want else []
                yield pa.RecordBatch.from_arrays([own, *more], names=["row", "fp", "sha", "chars", "data"][: 1 + len(more)])

        return tagged

    kind = rows.schema["row"]
    more = StructType([kind, StructField("fp", LongType()), StructField("sha", StringType()), StructField("chars", LongType())]).add("data", "binary")
    maybe = rows.mapInArrow(run(True), more)
    if bits:
        return rows.mapInArrow(run(False), StructType([kind])), maybe
    return None, join_hot(maybe, twice, ["fp"], ["sha", "chars", "row"], "inner").drop("n")


def _groups(routed: DataFrame, doc_id: Column) -> DataFrame:
    """(fp, sha, keep, keep_chars, n) of every group of two or more texts of the same bytes."""
    best = F.min(F.struct((-F.col("chars")).alias("c"), doc_id.isNull().alias("z"), doc_id.alias("i")))
    groups = routed.groupBy("fp", "data").agg(best.alias("best"), F.count("*").alias("n"), F.min("sha").alias("sha"))
    return materialise(groups.where("n > 1").select("fp", "sha", F.col("best.i").alias("keep"), (-F.col("best.c")).alias("keep_chars"), "n"), "groups")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same bytes after the six white-space characters
    are deleted.  Of equal texts the row with the most code points stays, then the
    smallest id.  A null text is empty; all empty texts are one group.  A null id sorts
    after every other id.  Rows that repeat both id and text are one document stored
    several times: each counts in group_size and carries the same answer.  Extra columns
    are ignored.  An empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "prints")
    twice = materialise(repeated(prints, measure(prints)), "repeated")
    row = F.struct(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).alias("row")
    groups = _groups(_routed(docs.select(row), twice, 1)[1], F.col("row.i"))
    joined = join_hot(prints.withColumnRenamed("text_sha256", "sha"), groups, ["fp", "sha"], ["doc_id", "chars"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of ``exact_groups``, with all their columns.

    Of rows of a group that repeat the id and the length, the one whose text comes first in
    the order of strings stays.  Only rows whose fingerprint is repeated are shuffled.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "prints")
    twice = materialise(repeated(prints, measure(prints)), "repeated")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    once, more = _routed(rows, twice, docs.columns.index(text_col))
    own = F.col("row").getField(id_col).cast("long")
    groups = _groups(more, own)
    met = join_hot(more.drop("data"), groups, ["fp", "sha"], ["chars", F.xxhash64(own)], "left")
    met = met.where(F.col("n").isNull() | own.eqNullSafe(F.col("keep")) & (F.col("chars") == F.col("keep_chars")))
    met = materialise(met.select("row", "fp", "sha", F.col("n").isNotNull().alias("grouped")), "routed")
    first = met.where("grouped").groupBy("fp", "sha").agg(F.min_by("row", F.col("row").getField(text_col)).alias("row"))
    kept = met.where("not grouped").select("row.*").union(first.select("row.*"))
    if once is None:  # rows that repeat no fingerprint are in no group and were not joined
        seen = twice.select(F.col("fp").alias("f"))
        whole = _with_prints(rows, docs.columns.index(text_col))
        once = whole.join(seen, F.col("fp") == F.col("f"), "left_anti").select("row")
    return once.select("row.*").union(kept)


def _with_prints(rows: DataFrame, text_at: int) -> DataFrame:
    """(row, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(_fingerprint(normalise(t.as_py()))) for t in batch.column(0).field(text_at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["row", "fp"])

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("fp", LongType())]))
