"""MinHash near-deduplication by an inverted join over signature coordinates.

A document's set of word shingles gets a signature of ``COORDINATES`` minima.  Documents
are posted under each (coordinate, value) pair.  Two documents whose signatures agree in at
least ``least_matches`` places must share one of the ``COORDINATES - least_matches + 1``
rarest postings of either (the prefix).  So only the lists of prefix postings are merged;
the more frequent ones are skipped, and the agreements there are counted from the signatures
of the pairs that a merge has found.  Pairs above the match threshold are retained and
confirmed on the full sets.

No list is expanded into all its pairs.  Equal sets are one class from the start.  Each
member of a list meets the list's first member; what this links is one cluster.  Only lists
whose members are still in several clusters go on: blocks of their members meet, pairs of
blocks inside the largest cluster are left out, and a meeting gives no more links than join
its members.  Clusters are confirmed by the same meetings, with the sets beside the signatures.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialise, measure, parts
from .components import connected_components

COORDINATES = 48
#: Members in a block of a list or cluster; blocks of very long ones are up to 64 times as large.
BLOCK = 256

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)
_SEEDS = _mix(np.arange(1001, 1001 + COORDINATES, dtype=np.uint64) * _BASE)
_FACTORS = _mix(np.arange(2001, 2001 + COORDINATES, dtype=np.uint64) * _BASE) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1 << 12), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    data = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    white = _IS_WHITE[data]
    inside = ~white
    before = np.empty_like(white)
    before[:1] = True
    before[1:] = white[:-1]
    starts = np.flatnonzero(inside & before)
    if not len(starts):
        return np.empty(0, np.uint64)
    ends = np.append(starts[1:], len(data))
    lengths = ends - starts
    tail = data[starts[0] :]
    place = np.arange(len(tail)) - np.repeat(starts - starts[0], lengths)
    values = _BYTE[tail] * _power_table(int(lengths.max()))[place]
    values[white[starts[0] :]] = 0
    return _mix(np.add.reduceat(values, starts - starts[0]))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; fewer words are one run."""
    own = word_hashes(text)
    n = min(words, len(own))
    if not n:
        return own
    out = own[: len(own) - n + 1] * np.uint64(3)
    for k in range(1, n):
        out = _mix(out * _BASE + own[k : len(own) - n + 1 + k])
    return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    """COORDINATES minima of a set that isn't empty."""
    out = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for at in range(0, len(own), 512):
        np.minimum(out, ((own[at : at + 512, None] ^ _SEEDS) * _FACTORS).min(0), out=out)
    return out


def least_matches(share: int, miss: float = 1e-6) -> int:
    """The match threshold: the most agreements that a pair of exactly ``share`` percent similarity
    falls short of with a probability below ``miss``, each coordinate agreeing with that share."""
    p, below, t = share / 100, 0.0, 0
    while t < COORDINATES:
        below += math.comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if below >= miss:
            break
        t += 1
    return max(1, t)


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, signs = [], [], []
            for text in batch.column(2):
                own = shingles(text.as_py(), words)
                counts.append(len(own))
                keys.append(_set_key(own))
                signs.append(signature(own).view(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "size", "set_key", "sig"])

    return run


def _set_key(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))


def near_groups(docs: DataFrame, words: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= ``share`` * union of their shingle sets;
    a component holds all documents that links reach, and is named by its smallest id.
    Signatures only propose pairs: a pair of exactly the least similarity is missed with a
    probability below 1e-6, and every link is confirmed on the full sets (of 64-bit shingle
    hashes).  A null or empty text has an empty set and is linked with nothing.  Rows with a
    null id form a component with nothing else (component_id null, kept true).  Repeated
    rows each get the same answer.  Other columns are ignored; an empty table gives no rows.
    """
    out = _grouped(docs, words, share, id_col, text_col)
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near(docs: DataFrame, words: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``near_groups``, with all its columns.

    The row with the component's smallest id stays; of several with that id, the one with
    the smallest hash of its text, and one of rows that repeat both.  Rows are told apart by
    id and text, so rows that share an id but no link don't drag each other along.  Rows
    without words and rows with a null id are linked with nothing and all stay.
    """
    grouped = materialise(_grouped(docs, words, share, id_col, text_col).where("part is not null").select("part", "doc_id", "text_hash"), "grouped")
    first = grouped.groupBy("part").agg(F.min(F.struct("doc_id", "text_hash")).alias("stays"))
    by_text = grouped.groupBy("part", "doc_id", "text_hash").agg(F.count("*").alias("n")).withColumnRenamed("part", "p")
    judged = by_text.join(first, F.col("p") == F.col("part")).select("doc_id", "text_hash", "n", (F.struct("doc_id", "text_hash") == F.col("stays")).alias("__stays"))
    # named rows: those that go, and those that stay but are there several times
    named = judged.where("not __stays or n > 1").select(F.col("doc_id").alias("i"), F.col("text_hash").alias("t"), "n", "__stays")
    named = materialise(named, "named", repeated=F.max(F.col("__stays").cast("int")))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("i"), F.xxhash64(F.col(text_col)).alias("t"))
    met = join_hot(whole, named, ["i", "t"], [f"row.`{c}`" for c, kind in docs.dtypes if "map<" not in kind], "left")
    out = met.where("__stays is null").select("row.*")
    if not measure(named, "repeated"):
        return out
    return out.union(met.where("__stays").groupBy("i", "t").agg(F.first("row").alias("row")).select("row.*"))


def _grouped(docs: DataFrame, words: int, share: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, size, set_key, part, component_id) of every row; the last two are null
    where the row is linked with nothing by rule.  part tells components apart."""
    rows = _texts(docs, id_col, text_col)
    sketches = materialise(rows.mapInArrow(_sketch(words), "doc_id long, text_hash long, size long, set_key binary, sig array<long>"), "sketches")
    known = sketches.where("set_key is not null and doc_id is not null")
    # one representative of each set, with a number of its own
    least = F.min(F.struct("doc_id", "text_hash")).alias("rep")
    sets = known.groupBy("set_key").agg(least, F.first("size").alias("size"), F.first("sig").alias("sig"), F.count("*").alias("n"))
    reps = materialise(sets.select("set_key", "rep.doc_id", "rep.text_hash", "size", "sig", "n", F.monotonically_increasing_id().alias("id")), "reps")
    links = _links(rows, reps, words, share)
    joined = connected_components(links).withColumnRenamed("component", "part")
    ids = reps.select("id", "doc_id")
    named = joined.join(ids, F.col("node") == F.col("id")).groupBy("part").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    named = join_hot(joined, materialise(named, "components"), ["part"], ["node"]).drop("n")
    whole = reps.join(named, F.col("id") == F.col("node"), "left").select("set_key", F.coalesce("part", "id").alias("part"), F.coalesce("component_id", "doc_id").alias("component_id"), "n")
    own = sketches.select("doc_id", "text_hash", "size", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    return join_hot(own, materialise(whole, "parts"), ["set_key"], ["doc_id", "text_hash"], "left").select("doc_id", "text_hash", "size", "set_key", "part", "component_id")


# ---------------------------------------------------------------- candidates


def _candidates(reps: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) above the match threshold, enough of them to join what all such pairs join,
    and the clusters (node, component) that they make."""
    matches = least_matches(share)
    posted = reps.select("id", F.posexplode("sig").alias("c", "v")).select("id", F.xxhash64("c", "v").alias("posting"))
    sizes = materialise(posted.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    common = join_hot(posted, sizes, ["posting"], ["id"]).select("id", F.struct("n", "posting").alias("p"))
    # postings of one document alone come first in the order of rarity, so they use up the prefix
    ranked = common.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    room = F.size("ps") - (matches - 1)
    lists = ranked.where(room > 0).select("id", F.explode(F.slice("ps", F.lit(1), room)).alias("p")).select("id", F.col("p.posting").alias("posting"))
    lists = materialise(lists, "lists")
    heads = materialise(lists.groupBy("posting").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1"), "heads")
    discard(sizes)
    met = join_hot(lists, heads, ["posting"], ["id"])
    # the merge: a pair that meets in several lists is one row from here on
    star = met.where("id <> head").groupBy(F.col("id").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("met"))
    signs = _signs(reps)
    most = heads.groupBy("head").agg(F.sum("n").alias("n"))
    signed = materialise(most.join(signs, F.col("head") == F.col("id")).select(F.col("head").alias("b"), "n", F.col("size").alias("size_b"), F.col("sign").alias("sign_b")), "heads")
    # what the skipped lists hold is counted from the signatures
    both = join_hot(star.join(signs, F.col("a") == F.col("id")).select("a", "b", "size", "sign"), signed, ["b"], ["a"])
    able = F.least("size", "size_b") * 100 >= F.greatest("size", "size_b") * share
    agree = F.size(F.filter(F.zip_with("sign", "sign_b", lambda x, y: x == y), lambda x: x))
    pairs = materialise(both.where(able).where(agree >= matches).select("a", "b"), "pairs")
    clusters = connected_components(pairs)
    if measure(heads, "most") <= 2:
        return pairs, clusters
    # lists of three or more, whose other members may agree with one another and not with the head
    rest = met.where("n > 2 and id <> head").select("posting", "id")
    labelled = rest.join(clusters, F.col("id") == F.col("node"), "left").select(F.col("posting").alias("group"), "id", F.coalesce("component", "id").alias("label"))
    more = materialise(_meetings(materialise(labelled, "open"), signs, share, matches, None), "more")
    if not measure(more):
        return pairs, clusters
    joined = clusters.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    return pairs.unionByName(more), connected_components(joined)


def _signs(reps: DataFrame) -> DataFrame:
    """(id, size, sign): signatures with 16 bits a coordinate, enough to count agreements."""
    return reps.select("id", "size", F.transform("sig", lambda v: F.shiftright(F.xxhash64(v), 48).cast("smallint")).alias("sign"))


# ---------------------------------------------------------------- meetings


def _meetings(members: DataFrame, payload: DataFrame, share: int, matches: int, words: int | None) -> DataFrame:
    """(a, b): links that join the members (group, id, label) of each group that belong together.

    Members with one label belong together already.  Blocks of a group's members meet, but
    those of its largest label not one another.  ``payload`` has the id's size and signature
    and, where links are confirmed, the bytes of its set.
    """
    labels = members.groupBy("group", "label").agg(F.count("*").alias("k"))
    top = F.max(F.struct("k", "label"))
    groups = labels.groupBy("group").agg(F.sum("k").alias("n"), top.alias("top"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    groups = materialise(groups, "groups")
    some = join_hot(members, groups, ["group"], ["id"])
    each = F.least(F.lit(64 * BLOCK), F.greatest(F.lit(BLOCK), F.ceil(F.col("n") / 64)))
    blocks = lambda k: F.ceil(k / each).cast("int")
    some = some.select("group", "id", "label", (F.col("label") == F.col("top.label")).alias("largest"), blocks(F.col("n") - F.col("top.k")).alias("others"), blocks(F.col("top.k")).alias("own"))
    # blocks of the other labels are numbered first
    place = lambda k: F.pmod(F.xxhash64("id", F.lit(3)), k).cast("int")
    block = F.when(F.col("largest"), F.col("others") + place(F.col("own"))).otherwise(place(F.col("others")))
    some = some.withColumn("block", block).join(payload.withColumnRenamed("id", "node"), F.col("id") == F.col("node")).drop("node")
    met = F.sequence(F.lit(0), F.when(F.col("largest"), F.col("others") - 1).otherwise(F.col("others") + F.col("own") - 1))
    dealt = some.select("*", F.explode(met).alias("m")).select("*", F.least("m", "block").alias("home"), F.greatest("m", "block").alias("away"))
    columns = ["group", "home", "away", "id", "label", "block", "size", "sign", *(["shingles"] if words else [])]
    by = ["group", "home", "away"]
    sorted_rows = dealt.select(*columns).repartition(parts(members.sparkSession), *by).sortWithinPartitions(*by)
    return sorted_rows.mapInArrow(_meet(share, matches, bool(words)), "a long, b long")


def _meet(share: int, matches: int, confirm: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams rows sorted by meeting, holds one meeting at a time."""

    def close(held: list[pa.RecordBatch], home: int, away: int) -> list[tuple[int, int]]:
        rows = pa.Table.from_batches(held)
        signs = rows["sign"].combine_chunks()
        signs = signs.flatten().to_numpy().reshape(len(signs), -1)
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()] if confirm else None
        return _join_members(*(rows[c].to_numpy() for c in ("id", "label", "block", "size")), signs, sets, share, matches, home, away)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, found = [], None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            cuts = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(own[:, a].tolist())
                if now != key:
                    if held:
                        found += close(held, key[1], key[2])
                    held, key = [], now
                held.append(batch.slice(a, b - a))
            yield _pairs(found)
            found = []
        if held:
            yield _pairs(close(held, key[1], key[2]))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _join_members(ids: np.ndarray, labels: np.ndarray, block: np.ndarray, sizes: np.ndarray, signs: np.ndarray, sets: list[np.ndarray] | None, share: int, matches: int, home: int, away: int) -> list[tuple[int, int]]:
    """Links between members of different labels; with two blocks, only those between them.

    Each member is compared with all others at once: sizes and signatures, then, with
    ``sets``, the full sets of those that agree and are not yet joined.
    """
    label = np.unique(labels, return_inverse=True)[1]
    out = []
    for i in range(len(ids)):
        if home != away and block[i] != home:
            continue
        rest = slice(i + 1, None) if home == away else slice(None)
        able = (label[rest] != label[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= share * np.maximum(sizes[rest], sizes[i]))
        if home != away:
            able &= block == away
        near = np.flatnonzero(able)
        if not len(near):
            continue
        near = near + (i + 1 if home == away else 0)
        near = near[(signs[near] == signs[i]).sum(1) >= matches]
        for j in near:
            if label[j] == label[i]:
                continue
            if sets is not None:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common < share * (sizes[i] + sizes[j] - common):
                    continue
            out.append((int(ids[i]), int(ids[j])))
            old, new = label[j], label[i]
            label[label == old] = new
    return out


# ---------------------------------------------------------------- links


def _links(rows: DataFrame, reps: DataFrame, words: int, share: int) -> DataFrame:
    """(a, b): links between representatives, confirmed on their full sets, enough of them to join what is linked."""
    candidates, clusters = _candidates(reps, share)
    clusters = clusters.withColumnRenamed("component", "group")
    wanted = reps.join(clusters, F.col("id") == F.col("node")).select("id", "doc_id", "text_hash", "set_key")
    sets = materialise(_full_sets(rows, wanted, words), "sets")
    members = clusters.select("group", F.col("node").alias("id"), F.col("node").alias("label"))
    found = None
    size = materialise(clusters.groupBy("group").agg(F.count("*").alias("n")), "clusters")
    if measure(size, "most") > BLOCK:
        # of clusters of several blocks, the pairs that made them are confirmed first
        large = join_hot(clusters, size, ["group"], ["node"]).where(F.col("n") > BLOCK).select("node")
        found = materialise(_confirmed(candidates.join(large, F.col("a") == F.col("node"), "left_semi"), sets, share), "confirmed")
        members = members.drop("label").join(connected_components(found), F.col("id") == F.col("node"), "left").select("group", "id", F.coalesce("component", "id").alias("label"))
    payload = sets.join(_signs(reps).select(F.col("id").alias("node"), "sign"), F.col("id") == F.col("node")).drop("node")
    more = materialise(_meetings(members, payload, share, least_matches(share), words), "links")
    return more if found is None else found.unionByName(more)


def _full_sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, size, shingles) of the wanted (id, doc_id, text_hash, set_key), shingles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t.as_py(), words) for t in batch.column(2)]
            same = pa.array([_set_key(x) == k for x, k in zip(own, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["id", "size", "shingles"])
            yield out.filter(same)

    named = wanted.select("id", "set_key", F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
    texts = rows.join(named, (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("t"))).select("id", "set_key", "text")
    found = texts.mapInArrow(run, "id long, size long, shingles binary")
    return found.groupBy("id").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))  # repeated rows


def _confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= share * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    heads = materialise(pairs.groupBy("b").agg(F.count("*").alias("n")).join(sets, F.col("b") == F.col("id")).select("b", "n", F.col("shingles").alias("set_b")), "head-sets")
    left = pairs.join(sets, F.col("a") == F.col("id")).select("a", "b", F.col("shingles").alias("set_a"))
    return join_hot(left, heads, ["b"], ["a"]).select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")
