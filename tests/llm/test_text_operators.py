import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from merlake.llm import byte_bpe, common, components, exact_dedup, near_dedup, packing, quality, simhash
from merlake.llm.common import WHITE, bucket_of
from merlake.llm.queries import op10_packing

from .helpers import WORDS, edge_docs, empty_docs, prose

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _shingles(text, words):
    own = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(own[i : i + words]) for i in range(len(own) - words + 1)) if len(own) >= words else frozenset([tuple(own)] if own else [])


# ---------------------------------------------------------------- exact dedup


def test_exact_groups(spark):
    docs = edge_docs(spark)
    rows = docs.select("doc_id", "text").collect()
    strip = lambda t: (t or "").translate(dict.fromkeys(map(ord, WHITE)))
    groups = defaultdict(list)
    for r in rows:
        groups[strip(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    want = sorted((str(r.doc_id), str(min(groups[strip(r.text)], key=lambda x: (x[0], x[1], x[2] or 0))[2]), len(groups[strip(r.text)]), hashlib.sha256(strip(r.text).encode()).hexdigest()) for r in rows)
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(strip(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_groups(empty_docs(spark)).count() == 0 == exact_dedup.drop_exact(empty_docs(spark)).count()


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    crowd = np.uint64(7 << 50) + np.arange(300, dtype=np.uint64)  # one long run that shifts those after it
    values = np.concatenate([values, crowd, values[:500], values[:40], np.repeat(values[7], 700), np.array([0, 2**64 - 1, 2**64 - 1], np.uint64)])
    found, counts = np.unique(values, return_counts=True)
    whole = exact_dedup.FilterBuilder()
    for chunk in np.array_split(rng.permutation(values), 9):
        whole.insert_all(chunk)
        whole._merge()
    parts = []
    for chunk in np.array_split(rng.permutation(values), 7):
        one = exact_dedup.FilterBuilder()
        one.insert_all(chunk)
        parts.append(exact_dedup.CountingQuotientFilter.from_bytes(one.finish().to_bytes()))
    for f in (whole.finish(), exact_dedup.CountingQuotientFilter.merged(parts), exact_dedup.CountingQuotientFilter.of(found, counts)):
        prints, ns = f.entries()
        assert (prints == found).all() and (ns == counts).all() and len(f.to_bytes()) < 14 * len(found)
        assert all(f.count(int(x)) == n for x, n in zip(found[::5], counts[::5], strict=True)) and f.count(12345) == 0 == f.count((7 << 50) + 300)
    blocks = defaultdict(list)
    for f in parts:
        for k, part in f.blocks(5):
            blocks[k].append(part)
    again = [(k << 59 | int(x), int(n)) for k in sorted(blocks) for x, n in zip(*exact_dedup.CountingQuotientFilter.merged(blocks[k]).entries(), strict=True)]
    assert again == list(zip(found.tolist(), counts.tolist(), strict=True))
    with pytest.raises(ValueError):
        exact_dedup.CountingQuotientFilter.merged([exact_dedup.CountingQuotientFilter(3), exact_dedup.CountingQuotientFilter(3, 60)])
    assert not list(exact_dedup.FilterBuilder().finish().blocks(4))


def test_exact_groups_without_a_bitmap_and_of_hot_texts(spark, monkeypatch):
    """The join that replaces the bitmap, and keys that are split, give the same rows."""
    docs = edge_docs(spark).unionByName(spark.range(100, 400).select(F.col("id").alias("doc_id"), F.lit("a copy").alias("text"), *[F.lit("c").alias(c) for c in edge_docs(spark).columns[2:]]))
    want = sorted(map(str, exact_dedup.exact_groups(docs).collect())), sorted(map(str, exact_dedup.drop_exact(docs).collect()))
    monkeypatch.setattr(exact_dedup, "ROUTE_BITS", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert (sorted(map(str, exact_dedup.exact_groups(docs).collect())), sorted(map(str, exact_dedup.drop_exact(docs).collect()))) == want


# ---------------------------------------------------------------- near dedup


def _components(texts, words, share):
    """By brute force: the sets of positions that links join."""
    sets = [_shingles(t, words) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= share * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    return sets, [root(i) for i in range(len(texts))]


@pytest.mark.parametrize(("words", "share"), [(3, 85), (5, 80)])
def test_near_groups_of_edges(spark, words, share):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    sets, roots = _components([t for _, t in rows], words, share)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    want = sorted((i, len(s), least[r] if s else i, i == (least[r] if s else i)) for (i, _), s, r in zip(rows, sets, roots, strict=True))
    got = near_dedup.near_groups(docs, words, share).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == want
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert near_dedup.near_groups(empty_docs(spark), words, share).count() == 0
    kept = near_dedup.drop_near(docs, words, share)
    assert kept.columns == docs.columns and sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == sorted({i for i, _, c, k in want if k})


def test_near_groups_of_chains_and_blocks(spark, monkeypatch):
    """Chains of small edits, a family of copies that share a passage, and clusters of several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(common, "HOT_ROWS", 9)
    rng = random.Random(8)
    texts = []
    for _ in range(4):
        own = prose(rng, 100).split()
        for _ in range(12):
            texts.append(" ".join(own))
            for _ in range(rng.choice([1, 2, 4])):
                own[rng.randrange(100)] = f"new{rng.randint(0, 999)}"
    passage = prose(rng, 60)
    texts += [passage + " " + prose(rng, 30) for _ in range(20)]
    sets, roots = _components(texts, 3, 85)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    least = {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs, 3, 85).collect()}
    assert got == {i: (len(sets[i]), least[r]) for i, r in enumerate(roots)}
    assert 4 <= len(set(roots)) < len(texts)


def test_rows_that_near_dedup_drops(spark, monkeypatch):
    """Rows that share an id but no link stay; of rows that repeat both id and text, one."""
    rng = random.Random(31)
    text, other, third = (prose(rng, 80) for _ in range(3))
    near = text + " more"
    rows = [(5, text, {"k": 1}), (17, near, None), (17, other, None), (18, third, None), (18, third, None), (18, third + " x", None), (19, third, None), (20, "", None), (20, "", None), (None, text, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n map<string,int>")
    for hot in (256, 1):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        kept = near_dedup.drop_near(docs)
        got = [(r.doc_id, r.text) for r in kept.collect()]
        assert kept.columns == docs.columns and sorted(x for x in got if x[0] not in (18, 20, None)) == [(5, text), (17, other)]
        assert len([x for x in got if x[0] == 18]) == 1 and got.count((20, "")) == 2 and got.count((None, text)) == 1 and len(got) == 6


def test_join_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.when(F.col("id") < 600, 1).otherwise(F.col("id") % 50)).cast("long").alias("k"), "id")
    keyed = common.materialise(rows.where("k is not null and k < 40").groupBy("k").agg(F.count("*").alias("n")), "keyed")
    want = sorted((r.id, r.k, r.n) for r in rows.join(keyed, "k").collect())
    assert sorted((r.id, r.k, r.n) for r in common.join_hot(rows, keyed, ["k"], ["id"]).collect()) == want
    assert common.join_hot(rows, keyed, ["k"], ["id"], "left").count() == 1000
    plan = common.join_hot(rows, keyed, ["k"], ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan and common.measure(keyed, "total") == sum(r[0] for r in keyed.select("n").collect())


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 5), (7, 3), (3, 7), (900, 1), (901, 1), (-4, 900)] + [(rng.randint(2000, 2050), rng.randint(2000, 2050)) for _ in range(40)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame([*edges, (None, 4)], "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(x, root(x)) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- fingerprints


def test_simhash_of_edges(spark):
    docs = edge_docs(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = defaultdict(list)
    for r in simhash.compare_with_next(docs).collect():
        got[r.doc_id, r.n_chars, r.edited_sha256].append(r)
    by_text = {}
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        found = got[i, len(t), hashlib.sha256(edited.encode()).hexdigest()]
        assert found
        r = found[0]
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint and re.fullmatch("[0-9a-f]{16}", r.edited_fingerprint)
        apart = (int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).bit_count()
        assert r.near_edited == 1 - apart / 64 and 0 <= r.near_next <= 1
    assert sum(map(len, got.values())) == len(rows)
    assert simhash.compare_with_next(empty_docs(spark)).count() == 0
    (one,) = simhash.compare_with_next(docs.where("doc_id = 13")).collect()
    assert one.near_next == 1.0


def test_simhash_votes(spark):
    df = spark.createDataFrame([(0, "b a b a")], "i long, t string")
    terms = [("b", "a"), ("a", "b"), ("b", "a"), ("a", None)]
    hashes = spark.createDataFrame(terms, "a string, b string").select(F.xxhash64("a", F.coalesce("b", F.lit(""))).alias("h")).collect()
    total = [0] * 64
    for (a, b), r in zip(terms, hashes, strict=True):
        for j in range(64):
            total[j] += (len(a) + len(b or "")) * (1 if r.h >> j & 1 else -1)
    (got,) = simhash.fingerprints(df, ["i"], "t").collect()
    assert got.fp % 2**64 == sum(1 << j for j in range(64) if total[j] > 0)


@pytest.mark.parametrize(("radius", "blocks"), [(0, 3), (3, 6), (5, 8)])
def test_block_tables_find_all_within_the_radius(spark, radius, blocks):
    rng = random.Random(6)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    prints = [s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for s in seeds for _ in range(6)]
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in [*prints, prints[0]]] + [(None,)], "fp long")
    q = spark.createDataFrame([(signed(x),) for x in seeds], "fp long")
    got = [(r.query_fp % 2**64, r.fp % 2**64, r.distance) for r in simhash.within_radius(q, df, radius, blocks).collect()]
    assert sorted(got) == sorted({(s, p, (s ^ p).bit_count()) for s in seeds for p in prints if (s ^ p).bit_count() <= radius})
    with pytest.raises(ValueError):
        simhash.block_masks(3, 3)


def test_buckets(spark):
    bounds = [3, 7, 8, 20, 21, 22, 50]
    got = spark.range(60).select("id", bucket_of(F.col("id"), bounds).alias("b")).collect()
    assert all(r.b == sum(x <= r.id for x in bounds) for r in got)
    assert spark.range(1).select(bucket_of(F.col("id"), []).alias("b")).first().b == 0


# ---------------------------------------------------------------- quality


def test_quality_on_held_out_texts(spark):
    rng = random.Random(12)
    good = [prose(rng, rng.randint(20, 200)) for _ in range(150)]
    bad = [" ".join(f"{w.upper()}!!" for w in prose(rng, rng.randint(20, 200)).split()) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, t, 0) for i, t in enumerate(bad)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [(scores[i] >= 0.7) == (q == 1) for i, _, q in rows if i % 3 == 0]
    assert sum(held) >= 0.95 * len(held)
    assert quality.fit(docs, labels) == model
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.7}
    edges = edge_docs(spark)
    own = quality.score(edges, model).collect()
    assert len(own) == edges.count() and all(0 <= r.score <= 1 for r in own)
    assert quality.keep_good(edges, model).columns == edges.columns
    assert quality.score(empty_docs(spark), model).count() == 0


@pytest.mark.parametrize("rows", [[], [("only good", 1)] * 5, [("bad", 0), ("good", 1)]])
def test_quality_with_few_labels(rows):
    model = quality.train(rows)
    assert all(0 < model.scorer().score(t) < 1 for t in ("", None, "any text"))


def test_quality_dictionaries_hold_whole_texts():
    assert quality._dictionary(["ab", "c" * 5, "é"], 100) == "abcccccé".encode()
    assert quality._dictionary(["ab", "c" * 5, "never"], 4) == b"abcc" and quality._dictionary([], 4) == b""


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def ranks(spark):
    return packing.load_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_transducer_equals_the_library(ranks):
    own = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN, max_seen=50, max_states=300)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    pieces = ["a", "é", "漢", "字", " ", "  ", "\n", "1", "23", "ing", "the", "!", "😀", "ا", "'s", "\x00", "\u00a0", *WORDS]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))
        assert own.encode(text) == library.encode_ordinary(text)
    long = "ab" * 3000 + "漢字" * 2000
    assert own.encode(long) == library.encode_ordinary(long)
    assert len(own.machine.states) <= 300 and len(own) <= 50
    with pytest.raises(ValueError):
        byte_bpe.MergeTransducer({b"a": 0})


def test_transducer_on_a_small_vocabulary():
    """Against the merge procedure itself, with merges that cross, nest and never apply."""
    rng = random.Random(3)
    for _ in range(20):
        ranks = {bytes([b]): b for b in range(256)}
        parts = [b"a", b"b", b"c"]
        for i in range(25):
            token = rng.choice(parts) + rng.choice(parts)
            if token not in ranks:
                ranks[token] = 256 + i
                parts.append(token)
        machine = byte_bpe.MergeTransducer(ranks)
        for _ in range(60):
            data = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 30)))
            own = [data[i : i + 1] for i in range(len(data))]
            while len(own) > 1:
                rank, at = min((ranks.get(own[i] + own[i + 1], 1 << 60), i) for i in range(len(own) - 1))
                if rank == 1 << 60:
                    break
                own[at : at + 2] = [own[at] + own[at + 1]]
            assert machine.encode(data) == [ranks[t] for t in own]


def test_vocabularies_that_differ_in_two_ranks(spark, ranks):
    """A worker that has encoded with one vocabulary encodes with the other one's merges."""
    other = dict(ranks)
    a, b = b" the", b" and"
    other[a], other[b] = ranks[b], ranks[a]
    docs = spark.createDataFrame([(0, "on the and")], "doc_id long, text string").coalesce(1)
    for own in (ranks, other, ranks):
        want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={}).encode_ordinary("on the and")
        assert np.frombuffer(byte_bpe.encode_documents(docs, own, public_tokenizers.PATTERN).first().ids, "<u4").tolist() == want
    assert byte_bpe.vocabulary_key(ranks, "x") != byte_bpe.vocabulary_key(other, "x")


def test_stream_decoder():
    data = "a漢😀é".encode() + b"\xff\xf0\x9f" + "x".encode() + b"\xe6\xbc"
    for size in range(1, 6):
        decoder = byte_bpe.StreamDecoder([])
        out = "".join(decoder.feed(data[i : i + size]) for i in range(0, len(data), size)) + decoder.finish()
        assert out == data.decode("utf-8", "replace")


def test_documents_come_back(spark, ranks):
    docs = edge_docs(spark)
    got = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN), ranks, chunk=3).collect()
    assert sorted((str(r.doc_id), r.text, r.decoded_sha256) for r in got) == sorted((str(r.doc_id), r.text or "", hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert byte_bpe.encode_documents(empty_docs(spark), ranks, public_tokenizers.PATTERN).count() == 0
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [(str(r.doc_id), library.encode_ordinary(r.text or "")) for r in docs.collect()]
    rows = byte_bpe.roundtrip_documents(docs, ranks, public_tokenizers.PATTERN, chunk=3).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in rows) == sorted((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in ids)


# ---------------------------------------------------------------- packing


def test_packing(spark):
    docs = edge_docs(spark)
    ranks = packing.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pieces(docs, ranks, public_tokenizers.PATTERN, end_id=2, with_ids=True, added=packing.load_added(public_tokenizers.path("byte_bpe_50k.json")))
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        for k, (a, n) in enumerate(packing.cut(len(ids), 1024)):
            want.append((str(r.doc_id), k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.collect()) == sorted(want)
    assert all(len(r.ids) == r.length for r in rows.collect())
    packed = packing.pack(rows.drop("ids"), chunk_rows=7).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    _check_bins([(r.sequence_id, r.offset, r.length) for r in packed], 1024)
    assert packing.pack(packing.pieces(empty_docs(spark), ranks, public_tokenizers.PATTERN, 2)).count() == 0


def test_added_tokens_in_raw_text(spark, tmp_path):
    """op10 and the pipeline's stage against the tokenizer as it is loaded, without settings."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"hello {end} world", end, end * 3, f"{end}a", f"a  {end}  b \n", f"it's{end}'s", "<|endoftext|", f"<{end}>", f"x {end} y " * 700, "plain", "", None]
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    want = []
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want += [(i, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 1024))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (op10_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == want


def _check_bins(rows, capacity):
    bins = defaultdict(list)
    for b, at, n in rows:
        bins[b].append((at, n))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)] and packing.cut(0, 4) == []


def test_local_search_empties_bins():
    for seed in range(20):
        rng = random.Random(seed)
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 400))]
        start = [[i] for i in range(len(lengths))]  # the worst start
        for bins in (packing.local_search(packing.best_fit(lengths, 100), lengths, 100), packing.local_search(start, lengths, 100)):
            assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
        assert len(packing.local_search(packing.best_fit(lengths, 100), lengths, 100)) <= len(packing.best_fit(lengths, 100))
    # best fit by falling length needs three bins of 10 here, exchanges need two
    lengths = [5, 4, 3, 3, 3, 2]
    assert len(packing.local_search([[0, 1], [2, 3, 4], [5]], lengths, 10)) == 2


def test_packing_where_no_bin_is_full(spark):
    """Lengths of which no two fit together: no round brings them nearer to one task."""
    rows = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(600).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    packed = packing.pack(rows)
    got = packed.agg(F.count("*"), F.countDistinct("sequence_id"), F.max("offset"), F.countDistinct("doc_id")).first()
    assert tuple(got) == (200_000, 200_000, 0, 200_000)


def test_exchanges_near_the_bound():
    rng = random.Random(4)
    lengths = [rng.randint(150, 450) for _ in range(3000)]
    bound, before = -(-sum(lengths) // 1024), packing.best_fit(lengths, 1024)
    assert bound <= len(packing.local_search(before, lengths, 1024)) < len(before) - (len(before) - bound) // 3


def test_packing_of_many_chunks(spark):
    rng = random.Random(5)
    lengths = [rng.choice([rng.randint(1, 1023), rng.randint(1, 200), 1024]) for _ in range(3000)]
    rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(rows, chunk_rows=50).collect()
    assert sorted(r.doc_id for r in packed) == list(range(3000))
    n = _check_bins([(r.sequence_id, r.offset, r.length) for r in packed], 1024)
    assert n <= -(-sum(lengths) // 1024) * 1.01 + 1


@pytest.mark.parametrize("share", [50, 80, 85, 95])
def test_match_threshold(share):
    from math import comb

    n, p, t = near_dedup.COORDINATES, share / 100, near_dedup.least_matches(share)
    below = lambda k: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))
    assert below(t) < 1e-6 <= below(t + 1)
