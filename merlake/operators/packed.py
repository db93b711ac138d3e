"""Counting k-mers in whole Arrow columns.

A task turns the letters of its sequences into codes of canonical k-mers, sorts a few
million at a time and hands on each once a sample, as deltas of the sorted keys in blocks
of bytes.  A block goes to the task of its range of keys, which merges what it gets into
rows sorted by partition, key and sample: the one shuffle of a build moves about two bytes
a row, and what it gives can be stored as it is.  Keys are codes multiplied by an odd
number, so that ranges of them are of one size whatever the sequences are, or cells.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import LONG_K
from ..functions.hashing import spark_xxhash64
from ..functions.md5 import first_words

#: K-mers that a task sorts at a time, letters that stay in a core's cache, keys that a task merges, about.
FLUSH, BLOCK, MERGE = 3_000_000, 1 << 16, 6_000_000
_LETTERS = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _LETTERS[[ord(_c), ord(_c.lower())]] = _i
_HEAD = "<qqqq"


def fits(k: int, samples: int, cells: int = 0, partitions: int = 1) -> bool:
    """Whether a key, its partition and its sample are one long together."""
    return _bits(partitions) + _bits(cells or 1 << 2 * k) + _bits(samples) <= 62


def answers(index) -> bool:
    """Whether ``hits_of`` can look up words in an index."""
    p = index.params
    return p.k <= LONG_K and (p.exact or p.hash != "xxh64") and fits(p.k, len(index.samples), p.window, p.partitions)


def _bits(n: int) -> int:
    return max(0, n - 1).bit_length()


def _odd(k: int) -> int:
    """About the golden ratio's share of all codes, and odd: multiplying by it keeps them apart."""
    return int((1 << 2 * k) * 0.6180339887498949) | 1


def codes_of(letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all k-mers of letters 0 to 3, and of their other strands; doubled from shorter ones."""
    ahead, back, width = letters.astype(np.int64), 3 - letters.astype(np.int64), 1
    out_a = out_b = None
    done, n = 0, len(letters) - k + 1
    while True:
        if k & width:
            # the pieces of k's binary digits follow each other, shortest first
            a, b = ahead[done : done + n], back[done : done + n]
            out_a = a if out_a is None else (out_a << 2 * width) | a
            out_b = b if out_b is None else out_b | (b << 2 * done)
            done += width
        if done == k:
            return out_a, out_b
        ahead, back = (ahead[:-width] << 2 * width) | ahead[width:], back[:-width] | (back[width:] << 2 * width)
        width *= 2


def least_pieces(code: np.ndarray, other: np.ndarray, k: int, m: int) -> np.ndarray:
    """The codes of the minimizers: the least m-mer of both strands."""
    mask = np.int64((1 << 2 * m) - 1)
    out = code & mask
    for x in (code, other):
        for j in range(k - m + 1):
            np.minimum(out, (x >> 2 * j) & mask, out=out)
    return out


def other_strand(code: np.ndarray, k: int) -> np.ndarray:
    x = ~code
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = ((x >> shift) & mask) | ((x & mask) << shift)
    x = ((x >> 32) & 0xFFFFFFFF) | (x << 32)
    return (x.view(np.uint64) >> np.uint64(64 - 2 * k)).view(np.int64)


def _hashed(codes: np.ndarray, k: int, n: int, method: str) -> np.ndarray:
    """As ``hashing.cell`` and ``hashing.partition_of`` have it, 0 to n - 1."""
    return (first_words(codes, k).astype(np.int64) if method == "md5" else spark_xxhash64(codes)) % np.int64(n)


@lru_cache(2)
def _part_table(m: int, partitions: int, method: str) -> np.ndarray:
    codes = np.arange(1 << 2 * m, dtype=np.int64)
    return np.concatenate([_hashed(codes[i : i + BLOCK], m, partitions, method) for i in range(0, len(codes), BLOCK)])


def parts_of(code: np.ndarray, other: np.ndarray, k: int, m: int, partitions: int, method: str) -> np.ndarray:
    """The partitions by the hash of the minimizers, which is looked up where all m-mers are few."""
    if partitions == 1:
        return np.zeros(len(code), np.int64)
    least = least_pieces(code, other, k, m)
    return _part_table(m, partitions, method)[least] if m <= 8 else _hashed(least, m, partitions, method)


def _words(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the k-mers of ACGT alone in the batch's (id, seq): the lesser and the greater code of their
    strands, their sequences' ids and their places there, in blocks."""
    batch = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
    seqs = batch.column(1).cast(pa.large_string())
    if not len(seqs):
        return
    at = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    if at[-1] - at[0] < k:
        return
    letters = _LETTERS[np.frombuffer(seqs.buffers()[2], np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    n = len(letters) - k + 1
    whole = np.ones(n + k, bool)
    bad = np.flatnonzero(letters == 4)
    letters[bad] = 0
    for j in range(k):
        whole[np.clip(bad - j, -1, n)] = False  # what is cut off meets in two places that nobody reads
        if j:
            whole[np.clip(at[1:-1] - j, -1, n)] = False
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for i in range(0, n, BLOCK):
        end = min(n, i + BLOCK)
        own = np.flatnonzero(whole[i:end])
        if not len(own):
            continue
        ahead, back = codes_of(letters[i : end + k - 1], k)
        first, last = np.searchsorted(at, i, "right") - 1, np.searchsorted(at, end)
        row = np.repeat(np.arange(first, last), np.diff(np.clip(at[first : last + 1], i, end)))
        if len(own) < end - i:
            ahead, back, row = ahead[own], back[own], row[own]
        yield np.minimum(ahead, back), np.maximum(ahead, back), ids[row], own + i - at[row]


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers as planes of bytes, the lowest first, so that empty ones cost nothing."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return width, np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(body: memoryview, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8")[:, 0].view(np.int64)


def pack(keys: np.ndarray, n: np.ndarray | None) -> bytes:
    """Sorted keys, and how often each occurs if that counts."""
    width, deltas = _planes(np.diff(keys, prepend=keys[:1]))
    many, counts = (0, b"") if n is None or n.max() == 1 else _planes(n)
    return struct.pack(_HEAD, int(keys[0]), len(keys), width, many) + deltas + counts


def unpack(body) -> tuple[np.ndarray, np.ndarray | None]:
    body = memoryview(body)
    first, size, width, many = struct.unpack_from(_HEAD, body)
    at = struct.calcsize(_HEAD)
    keys = np.cumsum(_unplanes(body, at, size, width)) + first
    return keys, _unplanes(body, at + size * width, size, many) if many else None


def combined(keys: list[np.ndarray], counts: list[np.ndarray | None] | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Each key once, sorted, with its sum unless ``counts`` is None; a missing count is one each."""
    own = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    more = [(k[c > 1], c[c > 1] - 1) for k, c in zip(keys, counts or []) if c is not None]
    own.sort()
    first = np.flatnonzero(np.concatenate([own[:1] == own[:1], own[1:] != own[:-1]]))
    n = None if counts is None else np.diff(first, append=len(own))
    own = own[first]
    for k, c in more:
        np.add.at(n, np.searchsorted(own, k), c)
    return own, n


def _bounds(space: int, tasks: int, sample_bits: int) -> np.ndarray:
    return np.array([-(-b * space // tasks) << sample_bits for b in range(tasks + 1)], np.int64)


def tasks_for(seqs: DataFrame, least: int) -> int:
    """Tasks that merge about ``MERGE`` keys each, by the size of the files that the sequences come from."""
    fs = seqs.sparkSession._jvm.org.apache.hadoop.fs.Path
    conf = seqs.sparkSession._jsc.hadoopConfiguration()
    size = 0
    for f in seqs.inputFiles():
        at = fs(f)
        size += at.getFileSystem(conf).getFileStatus(at).getLen()
    return min(1 << 15, max(least, 2 * size // MERGE))


class _Keys:
    """Keys of an index in equal ranges: cells numbered through the partitions, or multiplied codes."""

    def __init__(self, params):
        self.params, self.k, self.window = params, params.k, params.window
        self.method = "md5" if params.hash == "md5" else "xxhash64"
        self.space = params.partitions * params.window if params.window else 1 << 2 * params.k
        self.odd, self.mask = np.int64(_odd(self.k)), np.int64((1 << 2 * self.k) - 1)
        self.back = np.int64(pow(int(self.odd), -1, 1 << 2 * self.k))

    def parts(self, code: np.ndarray, other: np.ndarray) -> np.ndarray:
        return parts_of(code, other, self.k, self.params.m, self.params.partitions, self.method)

    def of(self, code: np.ndarray, other: np.ndarray) -> np.ndarray:
        if self.window:
            return self.parts(code, other) * self.window + _hashed(code, self.k, self.window, self.method)
        return (code * self.odd) & self.mask

    def of_rows(self, part: np.ndarray, key: np.ndarray) -> np.ndarray:
        return part.astype(np.int64) * self.window + key if self.window else (key * self.odd) & self.mask

    def code(self, keys: np.ndarray) -> np.ndarray:
        return (keys * self.back) & self.mask


def build_rows(seqs: DataFrame, samples: int, params, hard_min: int = 1) -> DataFrame:
    """The rows of an index of (sample_idx, seq), in tasks of about ``MERGE`` rows sorted by partition, key and sample."""
    k, window, held = params.k, params.window, _bits(samples)
    to, held_mask, counts = _Keys(params), np.int64((1 << held) - 1), params.bits > 1 or hard_min > 1
    tasks = tasks_for(seqs, seqs.sparkSession.sparkContext.defaultParallelism)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(to.space, tasks, held)

        def flushed(own: list[np.ndarray]) -> pa.RecordBatch:
            keys, n = combined(own, [] if counts else None)
            cut = np.searchsorted(keys, bounds)
            full = [b for b in range(tasks) if cut[b] < cut[b + 1]]
            bodies = [pack(keys[cut[b] : cut[b + 1]], None if n is None else n[cut[b] : cut[b + 1]]) for b in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(bodies, pa.binary())], ["task", "body"])

        own, size = [], 0
        for batch in batches:
            for code, other, sample, _ in _words(batch, k):
                if not 0 <= sample.min() <= sample.max() < samples:
                    raise ValueError(f"sample_idx must be between 0 and {samples - 1}")
                own.append((to.of(code, other) << held) | sample)
                size += len(sample)
                if size >= FLUSH:
                    yield flushed(own)
                    own, size = [], 0
        if own:
            yield flushed(own)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found = [], []
        for batch in batches:
            for body in batch.column(1):
                own, n = unpack(body.as_buffer())
                if not window:
                    code = to.code(own >> held)
                    # by partition and code from here on, so that one sort does both
                    own = (((to.parts(code, other_strand(code, k)) << 2 * k) | code) << held) | (own & held_mask)
                keys.append(own)
                found.append(n)
        if not keys:
            return
        own, n = combined(keys, found if counts else None)
        del keys, found
        if hard_min > 1:
            own, n = own[n >= hard_min], n[n >= hard_min]
        for i in range(0, len(own), BLOCK):
            key = own[i : i + BLOCK] >> held
            part, key = (key // window, key % window) if window else (key >> 2 * k, key & to.mask)
            cls = np.ones(len(key), np.int8) if params.bits == 1 else np.minimum(np.frexp(n[i : i + BLOCK].astype(float))[1], 2**params.bits - 1).astype(np.int8)
            sample = (own[i : i + BLOCK] & held_mask).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(key), pa.array(sample), pa.array(cls)], [*params.key, "sample_idx", "cls"])

    dealt = seqs.select("sample_idx", "seq").mapInArrow(split, "task int, body binary")
    return dealt.repartitionById(tasks, F.col("task")).mapInArrow(merged, f"part int, {params.key[1]} long, sample_idx int, cls byte")


def hits_of(index, seqs: DataFrame) -> DataFrame:
    """(qid, sample_idx, pos, cls) of the words of (qid, seq) in every sample that has them.

    Both sides go as blocks to the task of their range of keys and meet there: about two
    bytes a row of the index are shuffled, and sixteen or fewer a word.
    """
    params, held, to = index.params, _bits(len(index.samples)), _Keys(index.params)
    k, held_mask, spark = params.k, np.int64((1 << held) - 1), index.rows.sparkSession
    tasks = min(1 << 15, max(spark.sparkContext.defaultParallelism, index.rows.count() // (MERGE // 2)))
    bounds = lambda bits: _bounds(to.space, tasks, bits)
    names = ["task", "side", "body", "more"]

    def blocks(side: int, keys: np.ndarray, bits: int, others: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(keys, kind="stable")
        keys, others = keys[order], [x[order] for x in others]
        cut = np.searchsorted(keys, bounds(bits))
        full = [b for b in range(tasks) if cut[b] < cut[b + 1]]
        own = [slice(cut[b], cut[b + 1]) for b in full]
        packed = [[bytes([width]) + planes for width, planes in (_planes(x[s]) for x in others)] for s in own]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([side] * len(full), pa.int32()), pa.array([pack(keys[s], None) for s in own], pa.binary()), pa.array(packed, pa.list_(pa.binary()))], names)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0

        def flushed() -> pa.RecordBatch:
            return blocks(0, np.concatenate([x for x, _ in own]), held, [np.concatenate([x for _, x in own])])

        for batch in batches:
            part, key, sample, cls = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(4))
            own.append(((to.of_rows(part, key.astype(np.int64)) << held) | sample.astype(np.int64), cls))
            size += len(cls)
            if size >= FLUSH // 2:
                yield flushed()
                own, size = [], 0
        if size:
            yield flushed()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0

        def flushed() -> pa.RecordBatch:
            key, qid, pos = (np.concatenate(x) for x in zip(*own))
            return blocks(1, key, 0, [qid.view(np.uint64), pos])

        for batch in batches:
            for code, other, qid, pos in _words(batch, k):
                own.append((to.of(code, other), qid, pos))
                size += len(pos)
                if size >= FLUSH // 4:
                    yield flushed()
                    own, size = [], 0
        if own:
            yield flushed()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[list, list] = ([], [])
        for batch in batches:
            for side, body, more in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                keys, _ = unpack(body.as_buffer())
                known[side].append((keys, *[_unplanes(memoryview(x.as_buffer()), 1, len(keys), memoryview(x.as_buffer())[0]) for x in more]))
        if not known[0] or not known[1]:
            return
        rows, cls = (np.concatenate(x) for x in zip(*((x[0], x[1].astype(np.int8)) for x in known[0])))
        order = np.argsort(rows, kind="stable")
        rows, cls = rows[order], cls[order]
        stored_keys, samples = rows >> held, (rows & held_mask).astype(np.int32)
        del known[0][:], rows, order
        own_hits, size = [], 0

        def flushed() -> pa.RecordBatch:
            qid, sample, pos, c = (np.concatenate(x) for x in zip(*own_hits))
            order = np.argsort((qid << held) | sample)  # a sequence's hits of a sample together, which the next shuffle packs well
            return pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (qid, sample, pos, c)], ["qid", "sample_idx", "pos", "cls"])

        for keys, qid, pos in known[1]:
            first = np.searchsorted(stored_keys, keys)
            n = np.searchsorted(stored_keys, keys, "right") - first
            for i in range(0, len(keys), BLOCK):
                own = n[i : i + BLOCK]
                word = np.repeat(np.arange(i, i + len(own)), own)
                at = np.arange(len(word)) - np.repeat(np.cumsum(own) - own, own) + first[word]
                own_hits.append((qid[word], samples[at], pos[word], cls[at]))
                size += len(word)
                if size >= FLUSH // 2:
                    yield flushed()
                    own_hits, size = [], 0
        if size:
            yield flushed()

    schema = "task int, side int, body binary, more array<binary>"
    # places are those of letters, whatever bytes they have
    words = seqs.select(F.col("qid").cast("long"), F.regexp_replace("seq", "[^ACGTacgt]", "N")).mapInArrow(asked, schema)
    both = index.rows.select(*params.key, "sample_idx", "cls").mapInArrow(stored, schema).unionAll(words)
    return both.repartitionById(tasks, F.col("task")).mapInArrow(met, "qid long, sample_idx int, pos long, cls byte")
