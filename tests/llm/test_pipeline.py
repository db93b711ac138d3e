"""The pipeline and the registered queries on the smallest tables, by brute force."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from merlake.llm import quality, queries
from merlake.llm.common import WHITE, held_out

from .helpers import edge_docs

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def stages(spark):
    out, df = {}, spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = queries.common.new_path(spark, name)
        stage(spark, df, SMALL).write.parquet(path)
        df = out[name] = spark.read.parquet(path)
    return out


def test_stages(spark, docs, stages):
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert list(stages) == ["quality_classifier", "exact_dedup", "near_dedup", "packing"]
    assert all(df.columns == columns for name, df in list(stages.items())[:3])
    scores = {r.doc_id: r.predicted for r in queries.op2_quality(spark, SMALL).collect()}
    good = {i for i, p in scores.items() if p}
    assert {r.doc_id for r in stages["quality_classifier"].collect()} == good
    groups = defaultdict(list)
    for i in good:
        groups[docs[i].text.translate(dict.fromkeys(map(ord, WHITE)))].append((-len(docs[i].text), i))
    single = {min(own)[1] for own in groups.values()}
    assert {r.doc_id for r in stages["exact_dedup"].collect()} == single
    sets = {}
    for i in single:
        own = re.findall("[^\x20\x09-\x0d]+", docs[i].text.translate(LOWER))
        sets[i] = {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()
    parent = {i: i for i in single}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(single)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            common = len(a & b)
            if common and 100 * common >= 80 * (len(a) + len(b) - common):
                p, q = sorted((root(ids[x]), root(ids[y])))
                parent[q] = p
    left = {i for i in single if root(i) == i}
    assert {r.doc_id for r in stages["near_dedup"].collect()} == left
    packed = stages["packing"].collect()
    assert {r.doc_id for r in packed} == left
    fill = defaultdict(int)
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 3


def test_run(spark, stages):
    whole = corpus_pipeline.run(spark, SMALL)
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(whole) == key(stages["packing"])


def test_quality_on_held_out_rows(spark):
    """On rows that the classifier never saw, at the next larger size."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op2_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.8 * len(rows)
    good, bad = ([r.score for r in rows if labels[r.doc_id] == c] for c in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.85 * len(good) * len(bad)


def test_licence_lines_of_documents(spark, docs):
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "All rights reserved.": "reserved"}
    for r in queries.op4_licenses(spark, SMALL).collect():
        own = [lines[x] for x in docs[r.doc_id].text.split("\n") if x in lines]
        assert (r.n_licensed, r.families) == (len(own), ",".join(sorted(set(own)))) and r.n_paragraphs == docs[r.doc_id].text.count("\n") + 1


def _simhash(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    votes = [0] * 64
    for a, b in zip(words, [*words[1:], None], strict=True):
        h = xxhash.xxh64_intdigest((b or "").encode(), seed=xxhash.xxh64_intdigest(a.encode(), seed=42))
        for j in range(64):
            votes[j] += (len(a) + len(b or "")) * (1 if h >> j & 1 else -1)
    return sum(1 << j for j in range(64) if votes[j] > 0)


def test_simhash_query(spark, docs):
    """op1 against a SimHash of plain Python, with all pairs of fingerprints for the search."""
    order = sorted(docs, reverse=True)
    prints = {i: _simhash(docs[i].text) for i in order}
    alike = lambda x, y: 1 - (x ^ y).bit_count() / 64
    want = {}
    for k, i in enumerate(order):
        text, after = docs[i].text, order[(k + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + docs[after].text[:half]
        near = sum((prints[i] ^ prints[j]).bit_count() <= 3 for j in order if j != i) if i % 100 == 0 else None
        want[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[i]:016x}", f"{_simhash(edited):016x}", alike(prints[i], _simhash(edited)), alike(prints[i], prints[after]), near)
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.n_near) for r in queries.op1_simhash(spark, SMALL).collect()}
    assert got == want


def test_quality_query(spark, docs):
    """op2 against compressing every text in plain Python with the fitted model's dictionaries."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(table, labels.where(~held_out(labels.doc_id)))
    raw = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (model.good, model.bad)]
    rows = queries.op2_quality(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        data = docs[r.doc_id].text.encode()
        good, bad = (len(zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_dict_id=False).compress(data)) for d in raw)
        mean = (good + bad) / 2
        d = (bad - good) / mean
        x = model.weights[0] * d + model.weights[1] * d * math.log(mean) + model.weights[2] * d * math.log(mean / len(data)) + model.weights[3]
        assert abs(r.score - 1 / (1 + math.exp(-x))) < 1e-9 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_token_queries(spark, docs):
    """op7 and op10 against the libraries."""
    ranks = queries.packing.load_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()
    for r in queries.op7_byte_bpe(spark, SMALL).collect():
        ids = library.encode_ordinary(docs[r.doc_id].text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(docs[r.doc_id].text.encode()))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, row in docs.items():
        ids = [*tokenizer.encode(row.text, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024
        starts = ([0] if first else []) + list(range(first, len(ids), 1024))
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    packed = queries.op10_packing(spark, SMALL).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        ends = [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(places) <= -(-sum(x[3] for x in want) // 1024) + 1


def test_stages_on_edges(spark, tmp_path):
    """Nulls in any column, empty, long and repeated texts, clashing names, and empty tables."""
    docs = edge_docs(spark)
    labels = [(1, 1), (4, 0), (13, 1), (14, 0), (None, 1), (5, None), (17, 1), (17, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, df.limit(0), str(tmp_path))
        out = stage(spark, df, str(tmp_path))
        assert nothing.count() == 0 and (name == "packing" or nothing.columns == out.columns == docs.columns)
        path = queries.common.new_path(spark, name)
        out.write.parquet(path)
        before, df = df, spark.read.parquet(path)
        assert name == "packing" or df.count() <= before.count()
        if name == "quality_classifier":
            df = docs  # all of the edges go on


def test_query_shapes(spark):
    assert held_out and set(queries.SQL) <= set(queries.QUERIES) and len(queries.QUERIES) == 10
    first = queries.op1_simhash(spark, SMALL).collect()
    assert len(first) == 200 and sum(r.near_edited > r.near_next for r in first) > 180
    ids = {r.doc_id: r for r in queries.op7_byte_bpe(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert all(ids[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in docs)
