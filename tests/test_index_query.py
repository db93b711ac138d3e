import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from merlake.functions.encode import word_of
from merlake.operators import index as ix
from merlake.operators import layout, merge, query, summary
from merlake.operators.index import IndexParams

K = 9


def _rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _canon(s, k=K):
    return [min(s[i : i + k], _rc(s[i : i + k])) if set(s[i : i + k]) <= set("ACGT") else None for i in range(len(s) - k + 1)]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    base = letters(300)
    samples = {"s0": [base[:200], base[:60]], "s1": [base[100:], letters(50)], "s2": [_rc(base[50:150])] * 5}
    queries = [("q", base[20:120]), ("q", base[90:110] + "N" + base[110:190]), ("mixed", base[:30] + letters(20) + base[200:240]), ("short", base[:10]), ("none", letters(40))]
    return samples, queries


@pytest.fixture(scope="module")
def tables(spark, data):
    samples, queries = data
    seqs = spark.createDataFrame([(i, s) for i, own in enumerate(samples.values()) for s in own], "sample_idx int, seq string")
    asked = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(queries)], "qid long, name string, seq string")
    return seqs, asked


def _brute(samples, queries, z, bits=1, hard_min=1):
    out = {}
    for name, own in samples.items():
        counts = Counter(w for s in own for w in _canon(s) if w)
        cls = {w: min(n.bit_length(), 2**bits - 1) for w, n in counts.items() if n >= hard_min}
        for q, (_, s) in enumerate(queries):
            words = [cls.get(w, 0) for w in _canon(s)]
            nbk = len(s) - K + 1 - z
            if nbk < 1:
                continue
            wide = [min(words[i : i + z + 1]) for i in range(nbk)]
            out[q, name] = (nbk, sum(x > 0 for x in wide), sum(wide) // nbk, wide)
    return out


@pytest.mark.parametrize("z", [0, 1, 4])
@pytest.mark.parametrize("bits", [1, 2])
def test_exact_scores(data, tables, z, bits):
    index = ix.build(tables[0], list(data[0]), IndexParams(K, 5, 3, bits=bits))
    got = {(r.qid, r["sample"]): (r.nbk, r["count"], r["class"], list(r.positions)) for r in query.query(index, tables[1], z, positions=True).collect()}
    assert got == _brute(*data, z, bits)


def test_threshold_and_hard_min(data, tables):
    index = ix.build(tables[0], list(data[0]), IndexParams(K, 5, 3), hard_min=2)
    want = {k: v for k, v in _brute(*data, 2, hard_min=2).items() if v[1] / v[0] >= 0.3}
    got = {(r.qid, r["sample"]): r["count"] for r in query.query(index, tables[1], 2, threshold=0.3).collect()}
    assert got == {k: v[1] for k, v in want.items()} and got


@pytest.mark.parametrize("hashed", ["xxhash64", "xxh64", "md5"])
def test_long_kmers(data, tables, hashed):
    """k beyond what a long holds, in both forms."""
    samples, queries = data
    rows = [r["count"] for window in (0, 1 << 20) for r in query.query(ix.build(tables[0], list(samples), IndexParams(33, 5, 3, window, hash=hashed)), tables[1], 1).orderBy("qid", "sample").collect()]
    words = lambda s: {min(w, _rc(w)) for w in (s[i : i + 34] for i in range(len(s) - 33)) if set(w) <= set("ACGT")}
    want = [sum(s[i : i + 34] in x or _rc(s[i : i + 34]) in x for i in range(len(s) - 33)) for _, s in queries if len(s) >= 34 for x in ["|".join([*own, *map(_rc, own)]) for own in samples.values()]]
    assert words and rows == want + want


def test_windows_over_blocks(data, tables, monkeypatch):
    """Queries longer than a block of positions."""
    monkeypatch.setattr(query, "BLOCK", 10)
    index = ix.build(tables[0], list(data[0]), IndexParams(K, 5, 3, bits=2))
    got = {(r.qid, r["sample"]): (r.nbk, r["count"], r["class"], list(r.positions)) for r in query.query(index, tables[1], 3, positions=True).collect()}
    assert got == _brute(*data, 3, 2)


def test_bloom_has_no_false_negatives(data, tables):
    index = ix.build(tables[0], list(data[0]), IndexParams(K, 5, 2, 400))
    exact = _brute(*data, 1)
    for r in query.query(index, tables[1], 1).collect():
        assert r["count"] >= exact[r.qid, r["sample"]][1]


def test_merge_records(data, tables):
    index = ix.build(tables[0], list(data[0]), IndexParams(K, 5, 3, bits=2))
    scores = query.query(index, tables[1], 1, positions=True)
    brute = _brute(*data, 1, 2)
    presence = {(r.name, r["sample"]): (r.nbk, r["count"], round(r.ratio, 9)) for r in query.merge_records(scores, ["name"]).collect()}
    abundance = {(r.name, r["sample"]): (r["class"], round(r.ratio, 9), [list(p) for p in r.positions]) for r in query.merge_records(scores, ["name"], True, True).collect()}
    for s in data[0]:
        a, b = brute[0, s], brute[1, s]
        assert presence["q", s] == (a[0] + b[0], a[1] + b[1], round((a[1] + b[1]) / (a[0] + b[0]), 9))
        assert abundance["q", s] == ((a[2] + b[2]) // 2, round((a[1] / a[0] + b[1] / b[0]) / 2, 9), [a[3], b[3]])


def test_summary_and_masks(data, tables):
    index = ix.build(tables[0], list(data[0]), IndexParams(K, 5, 3))
    want = Counter(w for own in data[0].values() for w in {x for s in own for x in _canon(s) if x})
    sums = summary.summarise(index)
    assert {r.w: r.n_samples for r in sums.withColumn("w", word_of(F.col("kmer"), K)).collect()} == want
    got = {r.qid: list(r.counts) for r in summary.query_summary(index, sums, tables[1]).collect()}
    assert got == {q: [want.get(w, 0) for w in _canon(s)] for q, (_, s) in enumerate(data[1]) if len(s) >= K + 1}
    with pytest.raises(ValueError):
        summary.summarise(ix.build(tables[0], list(data[0]), IndexParams(K, 5, 3, bits=2)))
    masks = ix.to_masks(index)
    assert sorted(map(tuple, ix.from_masks(masks, index.params).collect())) == sorted(map(tuple, index.rows.collect()))
    packed = ix.pack_classes(ix.build(tables[0], list(data[0]), IndexParams(K, 5, 3, bits=2)))
    assert packed.count() == len(want)


def test_merge_rename_and_conflicts(data, tables):
    params = IndexParams(K, 5, 3)
    parts = [ix.build(tables[0].where(f"sample_idx in {w}").withColumn("sample_idx", F.col("sample_idx") - o), n, params) for w, o, n in (("(0, 1)", 0, ["s0", "s1"]), ("(2)", 2, ["s2"]))]
    whole = ix.build(tables[0], list(data[0]), params)
    a, b = (sorted((r.qid, r["sample"], r["count"]) for r in query.query(i, tables[1], 1).collect()) for i in (merge.merge(parts), whole))
    assert a == b
    assert merge.merge(parts, form="x{}").samples == ("x0", "x1", "x2")
    assert merge.merge(parts, ids=["a", "b", "c"]).samples == ("a", "b", "c")
    with pytest.raises(ValueError):
        merge.merge([parts[0], parts[0]])
    with pytest.raises(ValueError):
        merge.merge(parts, ids=["a", "b"])
    with pytest.raises(ValueError):
        merge.merge([parts[0], ix.build(tables[0], list(data[0]), IndexParams(K, 5, 2))])


def test_rewrite_keeps_answers(data, tables, tmp_path):
    index = ix.build(tables[0], list(data[0]), IndexParams(K, 5, 3, 4096))
    stored = layout.rewrite(index, f"file://{tmp_path}/z", similar=True, check=True)
    a, b = (sorted((r.qid, r["sample"], r["count"]) for r in query.query(i, tables[1], 2).collect()) for i in (index, stored))
    assert a == b and sorted(stored.samples) == sorted(index.samples)
    with pytest.raises(ValueError):
        layout.rewrite(index, "x", level=23)
    assert layout.similar_order(index, 500, 8) == layout.similar_order(index, 500) and sorted(layout.similar_order(index)) == [0, 1, 2]
    with pytest.raises(ValueError):
        layout.similar_order(index, group=5)
    assert ix.files_for(10**9, 4) == 63 and ix.files_for(0, 4) == 1


def test_empty_inputs(spark, data, tables):
    none = spark.createDataFrame([], "sample_idx int, seq string")
    index = ix.build(none, ["a"], IndexParams(K, 5, 3))
    assert {r["count"] for r in query.query(index, tables[1], 1).collect()} == {0}
    full = ix.build(tables[0], list(data[0]), IndexParams(K, 5, 3))
    assert query.query(full, spark.createDataFrame([], "qid long, name string, seq string"), 1).count() == 0


@pytest.mark.parametrize("bad", [{"k": 7}, {"k": 256}, {"k": 20, "m": 21}, {"k": 20, "partitions": 0}, {"k": 20, "bits": 9}, {"k": 20, "hash": "crc"}])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        IndexParams(**bad)
    for f, x in ((query.check_z, 9), (query.check_ratio, 1.5)):
        with pytest.raises(ValueError):
            f(x)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ACGTN", min_size=0, max_size=40), min_size=1, max_size=4), st.lists(st.text("ACGT", min_size=0, max_size=40), min_size=1, max_size=3))
def test_any_sequences(asked, own):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    seqs = spark.createDataFrame([(0, s) for s in own], "sample_idx int, seq string")
    rows = spark.createDataFrame([(i, "q", s) for i, s in enumerate(asked)], "qid long, name string, seq string")
    got = {(r.qid, r["sample"]): (r.nbk, r["count"], r["class"], list(r.positions)) for r in query.query(ix.build(seqs, ["a"], IndexParams(K, 5, 2)), rows, 1, positions=True).collect()}
    assert got == _brute({"a": own}, [("q", s) for s in asked], 1)
