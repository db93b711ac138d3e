"""Cells and partitions of k-mers.

Three hashes: ``xxhash64``, Spark's own and the fastest; ``md5``, its first 32 bits, which
other SQL engines reproduce; ``xxh64``, XXH64 with seed 0 over the two-bit code, which
matches indexes built by other tools, as an Arrow function that hashes whole columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .encode import digits, revcomp

HASHES = ("xxhash64", "md5", "xxh64")

#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _md5(x: Column) -> Column:
    return F.conv(F.substr(F.md5(x.cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long")


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(rows: np.ndarray) -> np.ndarray:
    """XXH64, seed 0, of every row of a matrix of fewer than 32 bytes a row."""
    n, size = rows.shape
    h = np.full(n, _P5 + np.uint64(size), np.uint64)
    at = 0
    while size - at >= 8:
        word = np.ascontiguousarray(rows[:, at : at + 8]).view("<u8")[:, 0]
        h = _turn(h ^ (_turn(word * _P2, 31) * _P1), 27) * _P1 + _P4
        at += 8
    if size - at >= 4:
        word = np.ascontiguousarray(rows[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64)
        h = _turn(h ^ (word * _P1), 23) * _P2 + _P3
        at += 4
    for k in range(at, size):
        h = _turn(h ^ (rows[:, k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def spark_xxhash64(codes: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of longs: XXH64 with seed 42."""
    h = _turn((_P5 + np.uint64(50)) ^ (_turn(codes.view(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def hashed_bytes(k: int) -> int:
    """How many bytes of a k-mer's code are hashed: 8 below 32 letters, 16 below 64, and from
    there, as the tools do whose indexes this matches, one for each 32 letters begun."""
    return 8 if k < 32 else 16 if k < 64 else k // 32 + 1


def _xxh64_cells(codes: pd.Series, k: int, window: int) -> pd.Series:
    """codes: strings of k digits, the first base first; the code is a little-endian number of two bits a base."""
    known = codes.notna()
    own = np.frombuffer("".join(codes[known]).encode(), np.uint8).reshape(-1, k)[:, ::-1] - ord("0")
    size = hashed_bytes(k)
    wide = np.zeros((len(own), 4 * max(size, -(-k // 4))), np.uint8)
    wide[:, :k] = own
    rows = (wide.reshape(len(own), -1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(2, dtype=np.uint8)[:, :size]
    out = pd.Series(pd.NA, index=codes.index, dtype="Int64")
    out[known] = (xxh64(np.ascontiguousarray(rows)) % np.uint64(window)).astype(np.int64)
    return out


def hash_of(kmer: Column, method: str = "xxhash64") -> Column:
    if method == "md5":
        return _md5(kmer)
    if method == "xxhash64":
        return F.xxhash64(kmer)
    raise ValueError(f"unknown hash {method!r}; known: {', '.join(HASHES)}")


def cell(kmer: Column, window: int, method: str = "xxhash64", k: int | None = None) -> Column:
    """The k-mer's cell in its partition, 0 to window - 1; ``xxh64`` needs k."""
    if method != "xxh64":
        return F.pmod(hash_of(kmer, method), F.lit(window)).cast("long")
    if k is None:
        raise ValueError("xxh64 needs the length of the k-mers")

    @F.pandas_udf("long")
    def cells(codes: pd.Series) -> pd.Series:
        return _xxh64_cells(codes, k, window)

    return cells(F.least(digits(kmer), digits(revcomp(kmer))))


def partition_of(minimizer: Column, partitions: int, method: str = "xxhash64") -> Column:
    """The partition of all k-mers that have this minimizer, 0 to partitions - 1."""
    return F.pmod(hash_of(minimizer, "md5" if method == "md5" else "xxhash64"), F.lit(partitions)).cast("int")
