"""Registered queries against their SQL on the smallest tables."""

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
CHOSEN = ["kmer_packed", "kmer_partition", "kmer_hash_cell", "index_masks", "query_pa_z4", "query_pa_bloom", "query_abs_positions", "query_multi_index", "query_jsonl_abs", "query_json_vec", "query_json_vec_abs", "query_jsonl_vec_abs", "query_matrix_abs", "service_query", "payload_query", "streamed_query", "packed_classes", "sum_query", "merge_rename_ids", "merge_conflicts", "mergeable_groups", "catalog_register", "source_fastq"]


def _plain(value):
    return float(value) if isinstance(value, Decimal) else value


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    df = entry.queries()[name](spark, SMALL)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(_plain(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
    assert Counter(tuple(_plain(x) for x in r) for r in df.collect()) == want


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 46


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["qid", "sample", "nbk", "count", "ratio"] and rows.count() == 800
