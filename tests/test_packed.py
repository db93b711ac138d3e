"""Counting and looking up k-mers in whole columns, against the plain joins."""

import random

import pytest
from pyspark.sql import functions as F

from merlake.operators import index as ix
from merlake.operators import layout, merge, packed, query
from merlake.operators.index import Index, IndexParams
from merlake.plans import queries

K = 11
FORMS = [IndexParams(K, 5, 3), IndexParams(K, 5, 3, hash="md5"), IndexParams(K, 9, 3, bits=2, hash="md5"), IndexParams(K, 5, 3, 4096), IndexParams(K, 5, 3, 500, hash="md5"), IndexParams(23, 8, 1)]


@pytest.fixture(scope="module")
def seqs(spark):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    long = letters(3000)
    rows = [(0, long), (0, long[:500] + "N" + long[400:900]), (1, None), (1, ""), (1, long[5:40].lower()), (2, "A" * 400), (2, "é" + long[100:160] + "日本" + long[10:80]), (2, "ACGT"), (None, long)]
    return spark.createDataFrame([*rows, (1, letters(200_000))], "sample_idx int, seq string").repartition(3)


def _plain(seqs, samples, params, hard_min=1):
    keyed = ix.with_key(ix.count_kmers(seqs.where("sample_idx is not null"), params.k, hard_min), params)
    if not params.exact:
        keyed = keyed.groupBy(*params.key, "sample_idx").agg(F.max("n").alias("n"))
    return Index(params, tuple(samples), keyed.select(*params.key, "sample_idx", ix.abundance_class(F.col("n"), params.bits).cast("byte").alias("cls")))


def _rows(index):
    return sorted(map(tuple, index.rows.collect()))


@pytest.mark.parametrize("params", FORMS)
def test_build_is_that_of_plain_counts_and_sorted(seqs, params, monkeypatch):
    monkeypatch.setattr(packed, "MERGE", 1 << 14)
    index = ix.build(seqs, ["a", "b", "c"], params)
    assert index.order == "sorted" and _rows(index) == _rows(_plain(seqs, "abc", params))
    for own in index.rows.rdd.map(tuple).glom().collect():
        assert own == sorted(own)


def test_hard_min_and_unknown_samples(seqs):
    params = IndexParams(K, 5, 3, bits=3, hash="md5")
    assert _rows(ix.build(seqs, ["a", "b", "c"], params, 2)) == _rows(_plain(seqs, "abc", params, 2))
    with pytest.raises(Exception, match="sample_idx"):
        ix.build(seqs, ["a", "b"], params).rows.count()


def test_rewriting_a_stored_index_neither_copies_nor_shuffles(spark, seqs, tmp_path):
    """the copy beside it and the shuffle of all rows were what the disk and the memory went to."""
    built = ix.build(seqs, ["a", "b", "c"], FORMS[4])
    ix.write(built, f"{tmp_path}/a")
    stored = built.with_rows(spark.read.parquet(f"{tmp_path}/a").select(*built.rows.columns), "split")
    again = layout.reorder(stored, layout.similar_order(stored, 50))
    assert again.order == "split" and "Exchange hash" not in again.rows._jdf.queryExecution().executedPlan().toString()
    assert _rows(layout.reorder(layout.rewrite(stored, f"{tmp_path}/b", similar=True), [again.samples.index(s) for s in "abc"])) == _rows(built)
    keys = stored.rows.select(*FORMS[4].key).distinct().count()
    assert sorted(layout.similar_order(stored, keys + 10)) == [0, 1, 2]


def test_merged_rows_are_stored_as_they_lie(seqs):
    """a merged index was copied and shuffled once more."""
    halves = [ix.build(seqs.where(w).withColumn("sample_idx", F.lit(0)), [n], FORMS[0]) for w, n in (("sample_idx = 0", "a"), ("sample_idx = 1", "b"))]
    assert merge.merge(halves).order == "split"


def test_few_words_are_sent_to_the_index(spark, seqs, monkeypatch):
    """F4, F6, F8: the whole index was shuffled for any query above Spark's own threshold."""
    index = ix.build(seqs, ["a", "b", "c"], FORMS[1])
    asked = seqs.where("length(seq) > 100").select(F.monotonically_increasing_id().alias("qid"), F.lit("q").alias("name"), "seq")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = query.query(index, asked, 2)
        assert few._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    want = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(query, "FEW", 0)
    assert sorted(map(tuple, query.query(index, asked, 2).collect())) == want


@pytest.mark.parametrize("params", FORMS)
def test_many_words_meet_the_index_in_blocks(seqs, params, monkeypatch):
    """all rows of the index and all words were sorted for a merge join."""
    monkeypatch.setattr(packed, "MERGE", 1 << 14)
    index = ix.build(seqs, ["a", "b", "c"], params)
    asked = seqs.select(F.monotonically_increasing_id().alias("qid"), F.lit("q").alias("name"), "seq")
    got = packed.hits_of(index, asked)
    want = query.lookup(index, query.prepare(asked, params, 0))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_names_of_samples_meet_texts_without_a_shuffle(spark):
    """texts were shuffled by the few names, so a task had all texts of a name."""
    docs, _ = queries.documents(spark, "/root/testdata/sf0.001")
    assert "strategy=broadcast" in docs._jdf.queryExecution().optimizedPlan().toString()


def test_hits_come_a_sequence_and_sample_at_a_time(spark, seqs):
    """hits came in the order of their keys, which the shuffle to the windows can't pack."""
    index = ix.build(seqs, ["a", "b", "c"], FORMS[1])
    asked = spark.createDataFrame([(7 * i, "q", "ACGT" * 5 + "A" * 40) for i in range(50)], "qid long, name string, seq string")
    for own in packed.hits_of(index, asked).rdd.map(lambda r: (r.qid, r.sample_idx)).glom().collect():
        assert own == sorted(own)
