"""The catalog of a folder of indexes: what each is and where its rows are.

The catalog is a small JSON table in the folder, read and written by Spark, so that it can
be in any store.  Every save writes a new numbered version beside the old one, and the last
whole version is the catalog, so a crash leaves the one before.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators import layout, summary
from ..operators.index import ENGINE_VERSION, Index, IndexParams
from ..operators.merge import merge as merge_indexes

SCHEMA = (
    "name string, path string, samples array<string>, k int, m int, partitions int, window long, bits int, hash string,"
    " index_size long, sha1 string, compressed boolean, summary string, engine_version string"
)
MODES = ("inplace", "symlink", "copy", "move", "move_or_copy")


class InvalidIndex(ValueError):
    """An index that isn't there, or can't be used as asked."""


@dataclass(frozen=True)
class Entry:
    """A registered index; summary is the path of its sample counts, or null."""

    name: str
    path: str
    samples: tuple[str, ...]
    params: IndexParams
    index_size: int = 0
    compressed: bool = False
    summary: str | None = None
    engine_version: str = field(default=ENGINE_VERSION)

    @property
    def sha1(self) -> str:
        return fingerprint(self.params)

    def row(self) -> tuple:
        p = self.params
        return (self.name, self.path, list(self.samples), p.k, p.m, p.partitions, p.window, p.bits, p.hash, self.index_size, self.sha1, self.compressed, self.summary, self.engine_version)

    def infos(self, with_path: bool = True) -> dict:
        out = {"nb_samples": len(self.samples), "index_size": self.index_size, "bloom_size": self.params.window * self.params.partitions, "nb_partitions": self.params.partitions, "smer_size": self.params.k, "minim_size": self.params.m, "bw": self.params.bits, "samples": list(self.samples), "sha1": self.sha1, "engine_version": self.engine_version}
        return out | ({"path": self.path} if with_path else {})


def fingerprint(params: IndexParams) -> str:
    """Equal for indexes that can be merged and share one look-up."""
    return hashlib.sha1(json.dumps(asdict(params), sort_keys=True).encode()).hexdigest()


class Catalog:
    """The indexes of a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.entries: dict[str, Entry] = {}
        if versions := self._versions():
            for r in spark.read.schema(SCHEMA).json(f"{self.root}/catalog/{versions[-1]}").collect():
                self.entries[r.name] = Entry(r.name, r.path, tuple(r.samples), IndexParams(r.k, r.m, r.partitions, r.window, r.bits, r.hash), r.index_size, r.compressed, r.summary, r.engine_version)

    # ------------------------------------------------------------ files

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        store, at = self._at(path)
        return store.exists(at)

    def size_mb(self, path: str) -> int:
        store, at = self._at(path)
        return int(store.getContentSummary(at).getLength()) >> 20

    def _delete(self, path: str) -> None:
        """Delete files below the catalog's own folder; what is registered elsewhere belongs to others."""
        if path.startswith(f"{self.root}/"):
            store, at = self._at(path)
            store.delete(at, True)

    # ------------------------------------------------------------ rows

    def names(self) -> list[str]:
        return sorted(self.entries)

    def has(self, name: str) -> bool:
        return name in self.entries

    def get(self, name: str) -> Entry:
        if name not in self.entries:
            raise InvalidIndex(f"no index {name!r}; known: {', '.join(self.names()) or 'none'}")
        return self.entries[name]

    def select(self, names: list[str] | None) -> list[str]:
        """The given names, or all; unknown ones are an error."""
        return [self.get(n).name for n in names] if names else self.names()

    def open(self, name: str) -> Index:
        entry = self.get(name)
        rows = self.spark.read.parquet(entry.path)
        return Index(entry.params, entry.samples, rows.select(*entry.params.key, "sample_idx", "cls"), "split")

    def _versions(self) -> list[str]:
        """The whole versions of the catalog, oldest first.  A version is whole when Spark has
        marked its folder, so one that was being written when a session died is not seen."""
        store, at = self._at(f"{self.root}/catalog")
        if not store.exists(at):
            return []
        names = [f.getPath().getName() for f in store.listStatus(at) if f.isDirectory()]
        return sorted(n for n in names if self._exists(f"{self.root}/catalog/{n}/_SUCCESS"))

    def save(self) -> None:
        """Write the next version; the last one stays beside it, older ones go."""
        before = self._versions()
        number = int(before[-1].split("-")[0]) + 1 if before else 0
        rows = [self.entries[n].row() for n in self.names()]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(f"{self.root}/catalog/{number:012d}-{uuid.uuid4().hex[:8]}")
        for old in before[:-1]:
            self._delete(f"{self.root}/catalog/{old}")

    def infos(self, with_path: bool = True) -> dict:
        out = {"index": {n: self.entries[n].infos(False) for n in self.names()}}
        return out | ({"path": self.root} if with_path else {})

    def infos_table(self) -> DataFrame:
        return self.spark.createDataFrame([self.entries[n].row() for n in self.names()], SCHEMA)

    def mergeable(self) -> list[list[str]]:
        """Groups of two or more uncompressed indexes with equal parameters."""
        groups: dict[str, list[str]] = {}
        for n in self.names():
            if not self.entries[n].compressed:
                groups.setdefault(self.entries[n].sha1, []).append(n)
        return [g for g in groups.values() if len(g) > 1]

    # ------------------------------------------------------------ changes

    def add(self, index: Index, name: str, files_per_partition: int | None = None, path: str | None = None) -> Entry:
        """Store an index in the folder, or at ``path``, and register it."""
        if self.has(name):
            raise InvalidIndex(f"index {name!r} is there already")
        path = path or f"{self.root}/{name}"
        ix.write(index, path, files_per_partition)
        self.entries[name] = Entry(name, path, index.samples, index.params, self.size_mb(path))
        self.save()
        return self.entries[name]

    def build(self, seqs: DataFrame, samples: list[str], name: str, params: IndexParams | None = None, like: str | None = None, hard_min: int = 1) -> Entry:
        """Build from (sample_idx, seq) and register; ``like`` takes another index's parameters."""
        if (params is None) == (like is None):
            raise InvalidIndex("give either the parameters or an index to take them from")
        return self.add(ix.build(seqs, samples, params or self.get(like).params, hard_min), name)

    def register(self, name: str, source: Entry, mode: str = "symlink") -> Entry:
        """Register an index stored elsewhere: in its place, as a copy, or moved into the folder."""
        if mode not in MODES:
            raise InvalidIndex(f"unknown mode {mode!r}")
        if self.has(name):
            raise InvalidIndex(f"index {name!r} is there already")
        path = source.path
        if mode not in ("inplace", "symlink"):
            path = f"{self.root}/{name}"
            moved = False
            if mode in ("move", "move_or_copy"):
                store, at = self._at(source.path)
                _, to = self._at(path)
                moved = store.rename(at, to)
                if not moved and mode == "move":
                    raise InvalidIndex(f"{source.path} can't be moved to {path}")
            if not moved:
                ix.write(Index(source.params, source.samples, self.spark.read.parquet(source.path)), path)
        self.entries[name] = replace(source, name=name, path=path)
        self.save()
        return self.entries[name]

    def remove(self, name: str, delete: bool = False) -> None:
        entry = self.get(name)
        del self.entries[name]
        self.save()
        if delete:
            self._delete(entry.path)

    def merge(self, names: list[str], new_name: str, form: str | None = None, ids: list[str] | None = None, delete: bool = False, new_path: str | None = None) -> Entry:
        """Merge registered indexes, of equal parameters and not compressed, under a new name; the rows
        are stored in the folder or at ``new_path``."""
        if len(names) < 2:
            raise InvalidIndex("merging takes two indexes or more")
        entries = [self.get(n) for n in names]
        if len({e.sha1 for e in entries}) > 1:
            raise InvalidIndex("indexes of different parameters can't be merged")
        if any(e.compressed for e in entries):
            raise InvalidIndex("compressed indexes can't be merged")
        out = self.add(merge_indexes([self.open(n) for n in names], form, ids), new_name, path=new_path)
        for n in names if delete else []:
            self.remove(n, True)
        return out

    def compress(self, name: str, level: int = 6, block_mb: int = 8, similar: bool = False, check: bool = False, delete: bool = False, sampling: int = 20_000, group: int = 0) -> Entry:
        """Rewrite an index with zstandard; the old files go only if asked, and only the catalog's own."""
        entry = self.get(name)
        if entry.compressed:
            raise InvalidIndex(f"index {name!r} is compressed already")
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        stored = layout.rewrite(self.open(name), path, level, block_mb, similar, check, None, sampling, group)
        self.entries[name] = replace(entry, path=path, samples=stored.samples, compressed=True, index_size=self.size_mb(path))
        self.save()
        if delete:
            self._delete(entry.path)
        return self.entries[name]

    def summarise(self, name: str, correct: bool = False, seed: int = 0, share: float = 0.0, words: int = 10_000) -> Entry:
        """Store an index's sample counts, less the ``share`` of samples expected to be false; with
        ``correct``, the share that ``words`` random k-mers find."""
        entry = self.get(name)
        if entry.compressed:
            raise InvalidIndex("a compressed index can't be summarised")
        index = self.open(name)
        if not 0 <= share <= 1:
            raise InvalidIndex(f"the share must be between 0 and 1, not {share}")
        share = summary.estimate_correction(index, words + index.params.k - 1, seed) if correct else share
        path = f"{self.root}/{name}-sums-{uuid.uuid4().hex[:8]}"
        sums = summary.summarise(index, share)
        files = ix.files_for(index.rows.count(), index.params.partitions)
        key = index.params.key[1]
        dealt = sums.repartition(index.params.partitions * files, F.col("part"), F.pmod(F.xxhash64(key), F.lit(files)))
        dealt.sortWithinPartitions(*index.params.key).write.partitionBy("part").parquet(path)
        self.entries[name] = replace(entry, summary=path)
        self.save()
        return self.entries[name]

    def sums(self, name: str) -> DataFrame:
        entry = self.get(name)
        if not entry.summary:
            raise InvalidIndex(f"index {name!r} has no summary")
        return self.spark.read.parquet(entry.summary).select(*entry.params.key, F.col("n_samples"))
