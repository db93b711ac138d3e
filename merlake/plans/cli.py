"""The command line: ``python -m merlake.plans.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import IndexParams, bloom_window
from ..operators.query import check_ratio, check_z, merge_records, query_many
from ..operators.summary import query_summary
from ..sources.samples import read_names, read_registrations, read_sample_list, read_samples
from ..sources.sequences import numbered, read_sequences, with_ids
from . import formats
from .catalog import MODES, Catalog, InvalidIndex
from .service import make_server


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="merlake")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        out = sub.add_parser(name, help=text)
        out.add_argument("--index", "-i", required=True, help="folder of the catalog")
        return out

    p = command("build", "build an index from a sample list")
    p.add_argument("--fof", required=True)
    p.add_argument("--register-as", required=True)
    p.add_argument("--from", dest="like")
    p.add_argument("--kmer-size", type=int, default=31)
    p.add_argument("--minim-size", type=int, default=10)
    p.add_argument("--nb-partitions", type=int, default=4)
    p.add_argument("--hard-min", type=int, default=1)
    p.add_argument("--hash", default="xxhash64")
    size = p.add_mutually_exclusive_group()
    size.add_argument("--bloom-size", type=int, help="cells of a Bloom index; without a size the index is exact")
    size.add_argument("--nb-cell", type=int, help="cells of an abundance Bloom index")
    p.add_argument("--bitw", type=int, default=1, help="bits of an abundance class")

    p = command("register", "register indexes stored elsewhere")
    p.add_argument("--name")
    p.add_argument("--index-path", help="folder of another catalog")
    p.add_argument("--from-file", help="lines of name, tab, folder of another catalog")
    p.add_argument("--mode", choices=MODES, default="symlink")

    for name, text in (("query", "query sequences"), ("query2", "query many indexes at once")):
        p = command(name, text)
        p.add_argument("--fastx", required=True, nargs="+")
        p.add_argument("--names", default="", help="a,b,c or @file; all if not given")
        p.add_argument("--zvalue", type=int, default=0)
        p.add_argument("--threshold", type=float, default=0.0)
        p.add_argument("--output", required=True)
        p.add_argument("--format", default="json", help="json, matrix, json_vec, jsonl or jsonl_vec; json makes one document an index, so large results are better written as lines")
        p.add_argument("--single-query", help="all records are one query of this name")
        p.add_argument("--batch-size", type=int, default=0, help="queries a batch; 0 for no batches")
        p.add_argument("--aggregate", action="store_true", help="unite the results of the batches")

    p = command("merge", "merge indexes")
    p.add_argument("--to-merge", required=True, help="a,b,c")
    p.add_argument("--new-name", required=True)
    p.add_argument("--rename", help="a form with {}, or f:file with an id a line")
    p.add_argument("--new-path", help="where to store the merged rows")
    p.add_argument("--delete-old", action="store_true")

    command("index-infos", "what the catalog has")

    p = command("compress", "rewrite an index with zstandard")
    p.add_argument("--name", required=True)
    p.add_argument("--level", type=int, default=6)
    p.add_argument("--block-size", type=int, default=8)
    p.add_argument("--reorder", action="store_true")
    p.add_argument("--sampling", type=int, default=20_000, help="keys that the order is made from")
    p.add_argument("--column-per-block", type=int, default=0, help="reorder within groups of so many samples, a multiple of 8")
    p.add_argument("--check", action="store_true")
    p.add_argument("--delete", action="store_true")

    p = command("sum-index", "store sample counts")
    p.add_argument("--name", required=True)
    p.add_argument("--fp-correction", type=float, default=0.0, help="share of samples expected to be false")
    p.add_argument("--estimate-correction", action="store_true", help="estimate that share")
    p.add_argument("--nbk", type=int, default=10_000, help="random k-mers for the estimate")

    p = command("sum-query", "sample counts of each k-mer")
    p.add_argument("--names", default="", help="a,b,c or @file; all that have sample counts if not given")
    p.add_argument("--zvalue", type=int, default=0, help="not used: counts are of k-mers")
    p.add_argument("--fastx", required=True, nargs="+")
    p.add_argument("--output", required=True)

    p = command("serve", "answer queries over HTTP")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8080)
    return top


def _query(spark: SparkSession, catalog: Catalog, a: argparse.Namespace) -> None:
    check_z(a.zvalue), check_ratio(a.threshold)
    names = catalog.select(read_names(spark, a.names) if a.names else None)
    form = formats.known_format(a.format)
    vectors = form.endswith("_vec")
    seqs = (numbered if a.batch_size else with_ids)(read_sequences(spark, a.fastx)).select("qid", "name", "seq")
    for abundance in (False, True):
        own = [n for n in names if (catalog.get(n).params.bits > 1) == abundance]
        if not own:
            continue
        scores = query_many({n: catalog.open(n) for n in own}, seqs, a.zvalue, positions=vectors)
        if a.single_query:
            scores = merge_records(scores, ["index"], abundance, vectors).withColumns({"qid": F.lit(0).cast("long"), "name": F.lit(a.single_query)})
        at = a.output + ("-abundance" if abundance and len(own) < len(names) else "")
        formats.write_results(scores, at, form, {n: list(catalog.get(n).samples) for n in own}, a.threshold, abundance, a.batch_size, a.aggregate)


def _register(spark: SparkSession, catalog: Catalog, a: argparse.Namespace) -> None:
    if bool(a.from_file) == bool(a.name and a.index_path):
        raise InvalidIndex("give either --name and --index-path, or --from-file")
    listed = [(a.name, a.index_path)] if a.name else [(r.name, r.path) for r in read_registrations(spark, a.from_file).collect()]
    for name, path in listed:
        other = Catalog(spark, path)
        found = other.entries.get(name) or (next(iter(other.entries.values())) if len(other.entries) == 1 else None)
        if not found:
            raise InvalidIndex(f"{path} has no index {name!r}")
        catalog.register(name, found, a.mode)


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    catalog = Catalog(spark, a.index)
    try:
        if a.command == "build":
            listed = read_sample_list(spark, a.fof)
            cells = a.bloom_size or a.nb_cell
            if a.bloom_size and a.bitw > 1 or a.nb_cell and a.bitw == 1:
                raise InvalidIndex("--bloom-size is for presence, --nb-cell for abundance (--bitw 2 or more)")
            params = None if a.like else IndexParams(a.kmer_size, a.minim_size, a.nb_partitions, bloom_window(cells, a.nb_partitions) if cells else 0, a.bitw, a.hash)
            catalog.build(read_samples(spark, listed), [r.sample_id for r in listed.orderBy("sample_idx").collect()], a.register_as, params, a.like, a.hard_min)
        elif a.command == "register":
            _register(spark, catalog, a)
        elif a.command in ("query", "query2"):
            _query(spark, catalog, a)
        elif a.command == "merge":
            ids = read_names(spark, f"@{a.rename[2:]}") if a.rename and a.rename.startswith("f:") else None
            catalog.merge(a.to_merge.split(","), a.new_name, None if ids else a.rename, ids, a.delete_old, a.new_path)
        elif a.command == "index-infos":
            print(json.dumps(catalog.infos(), indent=2))
            for group in catalog.mergeable():
                print("can be merged:", ", ".join(group), file=sys.stderr)
        elif a.command == "compress":
            catalog.compress(a.name, a.level, a.block_size, a.reorder, a.check, a.delete, a.sampling, a.column_per_block)
        elif a.command == "sum-index":
            catalog.summarise(a.name, a.estimate_correction, share=a.fp_correction, words=a.nbk)
        elif a.command == "sum-query":
            seqs = with_ids(read_sequences(spark, a.fastx))
            asked = catalog.select(read_names(spark, a.names)) if a.names else [n for n in catalog.names() if catalog.get(n).summary]
            if not asked:
                raise InvalidIndex("no index has sample counts")
            lines = [formats.summary_jsonl(query_summary(catalog.open(n), catalog.sums(n), seqs), n).withColumn("index", F.lit(n)) for n in asked]
            reduce(DataFrame.unionByName, lines).select("index", "value").write.mode("overwrite").partitionBy("index").text(a.output)
        elif a.command == "serve":
            make_server(catalog, a.host, a.port).serve_forever()
    except (InvalidIndex, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("merlake").getOrCreate(), sys.argv[1:]))
