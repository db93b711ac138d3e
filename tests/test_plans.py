import asyncio
import bz2
import gzip
import json
import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from merlake.operators.index import IndexParams
from merlake.plans import client, formats, service
from merlake.plans.catalog import Catalog, InvalidIndex
from merlake.plans.cli import run
from merlake.sources import samples, sequences
from merlake.streaming import queries as streaming

RNG = random.Random(9)
SEQS = {n: "".join(RNG.choice("ACGT") for _ in range(200)) for n in "abc"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("data")
    (top / "a.fa").write_text(f">a1 first\n{SEQS['a'][:100]}\n{SEQS['a'][100:]}\n")
    with gzip.open(top / "b.fasta.gz", "wt") as f:
        f.write(f">b1\r\n{SEQS['b'].lower()}\r\n>b2\nACGT\n")
    with bz2.open(top / "c.fq.bz2", "wt") as f:
        f.write(f"@c1 x\n{SEQS['c']}\n+\n{'@' * 200}\n")
    (top / "fof.txt").write_text(f"A: {top}/a.fa\nB: {top}/b.fasta.gz ; {top}/c.fq.bz2\n")
    (top / "query.fa").write_text(f">q1\n{SEQS['a'][10:90]}\n>q2\n{SEQS['c'][50:150]}\n>q1\n{SEQS['b'][:60]}\n")
    return top


def test_readers(spark, folder):
    own = {r.name: r.seq for r in sequences.read_sequences(spark, [str(folder / x) for x in ("a.fa", "b.fasta.gz", "c.fq.bz2")]).collect()}
    assert own == {"a1": SEQS["a"], "b1": SEQS["b"], "b2": "ACGT", "c1": SEQS["c"]}
    listed = samples.read_sample_list(spark, str(folder / "fof.txt"))
    assert [(r.sample_idx, r.sample_id, len(r.files)) for r in listed.orderBy("sample_idx").collect()] == [(0, "A", 1), (1, "B", 2)]
    assert sorted((r.sample_idx, r.name) for r in samples.read_samples(spark, listed).collect()) == [(0, "a1"), (1, "b1"), (1, "b2"), (1, "c1")]
    for payload in (">x y\nAC\nGT\n>z\nTT", "@x y\nACGT\n+\nIIII\n@z\nTT\n+\nII"):
        assert sorted((r.name, r.seq) for r in sequences.parse_payload(spark, payload).collect()) == [("x", "ACGT"), ("z", "TT")]
    assert sequences.read_sequences(spark, []).count() == 0
    one, two = (sequences.random_sequence(spark, 500, s).first().seq for s in (1, 2))
    assert len(one) == 500 and set(one) <= set("ACGT") and one != two
    (folder / "names.txt").write_text("x\n y \n\n")
    assert samples.read_names(spark, f"@{folder}/names.txt") == samples.read_names(spark, "x, y") == ["x", "y"]
    (folder / "reg.tsv").write_text("n1\t/p1\nn2\t/p2\n")
    assert [tuple(r) for r in samples.read_registrations(spark, f"{folder}/reg.tsv").collect()] == [("n1", "/p1"), ("n2", "/p2")]
    assert sequences.is_sequence_file("x.fna.gz") and not sequences.is_sequence_file("x.txt")


@pytest.fixture(scope="module")
def catalog(spark, folder):
    root = f"{folder}/indexes"
    for name, more in (("pa", ["--bloom-size", "400000"]), ("exact", []), ("abs", ["--nb-cell", "400000", "--bitw", "2"])):
        assert run(spark, ["build", "-i", root, "--fof", f"{folder}/fof.txt", "--register-as", name, "--kmer-size", "21", *more]) == 0
    return Catalog(spark, root)


def test_catalog(spark, folder, catalog, capsys):
    root = catalog.root
    assert catalog.names() == ["abs", "exact", "pa"] and catalog.has("pa")
    infos = catalog.infos()["index"]["pa"]
    assert (infos["nb_samples"], infos["bloom_size"], infos["bw"], infos["samples"]) == (2, 400000, 1, ["A", "B"])
    with pytest.raises(InvalidIndex):
        catalog.get("no")
    assert run(spark, ["build", "-i", root, "--fof", f"{folder}/fof.txt", "--register-as", "pa2", "--from", "pa"]) == 0
    assert run(spark, ["merge", "-i", root, "--to-merge", "pa,pa2", "--new-name", "both"]) == 1
    assert run(spark, ["merge", "-i", root, "--to-merge", "pa,abs", "--new-name", "both", "--rename", "S{}"]) == 1
    assert run(spark, ["merge", "-i", root, "--to-merge", "pa,pa2", "--new-name", "both", "--rename", "S{}"]) == 0
    assert Catalog(spark, root).get("both").samples == ("S0", "S1", "S2", "S3")
    assert ["both", "pa", "pa2"] in Catalog(spark, root).mergeable()
    assert run(spark, ["compress", "-i", root, "--name", "pa2", "--check", "--reorder", "--delete"]) == 0
    assert run(spark, ["sum-index", "-i", root, "--name", "pa2"]) == 1
    assert run(spark, ["sum-index", "-i", root, "--name", "pa", "--estimate-correction", "--nbk", "500"]) == 0
    assert run(spark, ["sum-index", "-i", root, "--name", "pa", "--fp-correction", "1.5"]) == 1
    assert run(spark, ["sum-index", "-i", root, "--name", "pa", "--fp-correction", "0.6"]) == 0
    assert {r.n_samples for r in Catalog(spark, root).sums("pa").select("n_samples").distinct().collect()} <= {0, 1}
    assert run(spark, ["sum-index", "-i", root, "--name", "exact"]) == 0
    assert run(spark, ["sum-query", "-i", root, "--names", "exact", "--fastx", f"{folder}/query.fa", "--output", f"{folder}/sums"]) == 0
    assert run(spark, ["sum-query", "-i", root, "--fastx", f"{folder}/query.fa", "--output", f"{folder}/all-sums"]) == 0
    assert {r["index"] for r in spark.read.text(f"{folder}/all-sums").collect()} == {"exact", "pa"}
    lines = [json.loads(r.value) for r in spark.read.text(f"{folder}/sums").collect()]
    assert sorted((x["query"], len(x["abs"]), set(x["abs"]) == {1}) for x in lines) == [("q1", 40, True), ("q1", 60, True), ("q2", 80, True)]
    other = f"{folder}/other"
    for mode, name in (("symlink", "linked"), ("copy", "copied")):
        assert run(spark, ["register", "-i", other, "--name", name, "--index-path", root, "--mode", mode]) == 1
        Catalog(spark, other).register(name, Catalog(spark, root).get("exact"), mode)
    assert Catalog(spark, other).open("copied").rows.count() == Catalog(spark, root).open("exact").rows.count()
    assert run(spark, ["index-infos", "-i", root]) == 0
    assert '"nb_samples": 2' in capsys.readouterr().out
    Catalog(spark, other).remove("copied", delete=True)
    assert Catalog(spark, other).names() == ["linked"]
    # what is registered from elsewhere isn't deleted with its entry
    Catalog(spark, other).remove("linked", delete=True)
    assert Catalog(spark, other).names() == [] and Catalog(spark, root).open("exact").rows.count() > 0
    # a version that was being written when its session died is not the catalog
    before = Catalog(spark, root).names()
    Path(f"{root}/catalog/999999999999-broken").mkdir()
    assert Catalog(spark, root).names() == before and len(Catalog(spark, root)._versions()) <= 2
    Path(f"{root}/catalog/999999999999-broken").rmdir()


@pytest.mark.parametrize("form", formats.NAMES)
@pytest.mark.parametrize("name", ["exact", "abs"])
def test_formats(spark, folder, catalog, form, name):
    out = f"{folder}/out-{form}-{name}"
    assert run(spark, ["query", "-i", catalog.root, "--names", name, "--fastx", f"{folder}/query.fa", "--zvalue", "3", "--threshold", "0.5", "--output", out, "--format", form]) == 0
    # the files are in the order of their names
    read = spark.read.text(out).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("m"))
    rows = [r.value for r in read.orderBy(F.substring("file", 1, 10), "m").collect()]
    value = lambda ratio: ratio if name == "exact" else int(ratio)
    if form == "matrix":
        assert rows == [f"{name}\tA\tB"] + [f"{name}:{q}\t{value(a)}\t{value(b)}" for q, a, b in (("q1", 1.0, 0.0), ("q2", 0.0, 1.0), ("q1", 0.0, 1.0))]
        return
    got = [json.loads(x) for x in rows]
    if form.startswith("jsonl"):
        # lines of abundances keep all samples
        assert [x["query"] for x in got] == ["q1", "q2", "q1"] and [sorted(x["samples"]) for x in got] == ([["A"], ["B"], ["B"]] if name == "exact" else [["A", "B"]] * 3)
        first = got[1]["samples"]["B"]
    else:
        assert sorted(got[0][name]) == ["q1", "q2"]
        first = got[0][name]["q2"]["B"]
    if form.endswith("vec"):
        assert first["P"] == [1] * 77 and ("C" in first) == (name == "abs") and first.get("R") == (None if (form, name) == ("jsonl_vec", "abs") else 1.0)
    else:
        assert first == 1


def test_single_query_and_batches(spark, folder, catalog):
    out = f"{folder}/single"
    assert run(spark, ["query2", "-i", catalog.root, "--names", "exact", "--fastx", f"{folder}/query.fa", "--output", out, "--format", "jsonl", "--single-query", "all", "--batch-size", "2"]) == 0
    (line,) = [json.loads(r.value) for r in spark.read.text(out).select("value").collect()]
    assert line["query"] == "all" and line["samples"] == {"A": 60 / 180, "B": 120 / 180}
    assert run(spark, ["query", "-i", catalog.root, "--names", "nope", "--fastx", f"{folder}/query.fa", "--output", out]) == 1
    assert formats.known_format("what") == "json"
    read = lambda at: sorted((str(r["batch"]) if "batch" in r else "", r.value) for r in spark.read.text(at).collect())
    for form, whole in (("jsonl", 3), ("matrix", 4), ("json", 1)):
        ask = ["query", "-i", catalog.root, "--names", "exact", "--fastx", f"{folder}/query.fa", "--format", form, "--batch-size", "2"]
        assert run(spark, [*ask, "--output", f"{out}-{form}"]) == run(spark, [*ask, "--output", f"{out}-{form}-one", "--aggregate"]) == 0
        batches, one = read(f"{out}-{form}"), read(f"{out}-{form}-one")
        assert {b for b, _ in batches} == {"0", "1"} and len(one) == whole and len(batches) == whole + (form != "jsonl")


def test_split_fastq(spark, folder):
    """Records of a file that is read in many splits, with qualities that look like headers."""
    rows = [(f"r{i}", "".join(RNG.choice("ACGT") for _ in range(30))) for i in range(400)]
    (folder / "big.fq").write_text("".join(f"@{n} x\n{s}\n+\n{'@' * 30}\n" for n, s in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        seqs = sequences.read_fastq(spark, [str(folder / "big.fq"), str(folder / "c.fq.bz2")])
        assert sorted((r.name, r.seq) for r in seqs.collect()) == sorted([*rows, ("c1", SEQS["c"])])
        ids = [r.qid for r in sequences.numbered(seqs).collect()]
        assert sorted(ids) == list(range(401))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_service_and_client(catalog):
    server = service.make_server(catalog, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        c = client.Client(port=server.server_address[1])
        assert c.infos()["index"]["pa"]["nb_samples"] == 2
        q = client.Query("id", SEQS["a"][:80], "exact", z=3)
        assert c.submit(q).samples("exact", "id") == {"A": 1.0, "B": 0.0}
        both = client.Query("id", [SEQS["a"][:80], SEQS["c"][:80]], ["exact", "pa"], r=0.4, z=0)
        assert set(c.submit(both).json()) == {"exact", "pa"}
        batch = client.Batch().add(q).push(client.Query("bad", "ACGT", "exact"))
        ok, bad = asyncio.run(c.submit_async(batch))
        assert ok.ok and bad.status == 400
        tsv = c.submit(client.Query("id", SEQS["a"][:80], "exact", format="tsv"))
        assert tsv.body.splitlines()[:2] == ["exact\tA\tB", "exact:id\t1.0\t0.0"]
        vec = c.submit(client.Query("id", SEQS["c"][:80], "abs", z=0, r=0.5, format="json_vec")).samples("abs", "id")
        assert vec["B"]["P"] == [1] * 60 and vec["B"]["C"] == 1
        fastx = json.dumps({"index": ["exact"], "fastx": f">x\n{SEQS['b'][:80]}\n", "z": 1, "id": "f"})
        assert json.loads(service.handle_query(catalog, fastx)[2]) == {"exact": {"f": {"A": 0.0, "B": 1.0}}}
        for broken in ("{", "[]", '{"index": ["exact"]}', '{"index": ["exact"], "seq": ["A"], "fastx": "x", "z": 1}', '{"index": ["exact"], "id": "x", "seq": ["A"]}', f'{{"index": ["exact"], "seq": ["{SEQS["a"]}"], "z": 1}}', '{"index": ["nope"], "seq": ["A"], "z": 1}', '{"index": ["exact"], "seq": ["A"], "z": 99}'):
            assert service.handle_query(catalog, broken)[0] == 400
    finally:
        server.shutdown()


def test_stream(spark, folder, catalog):
    inbox = folder / "inbox"
    inbox.mkdir()
    (inbox / "1.fa").write_text(f">s1\n{SEQS['a'][:80]}\n>s2\n{SEQS['c'][:80]}\n")
    (inbox / "2.fa").write_text(f">s3\n{SEQS['b'][:80]}\n")
    q = streaming.stream_query(catalog.open("exact"), streaming.stream_sequences(spark, str(inbox), 1), streaming.parquet_sink(f"{folder}/stream"), f"{folder}/state", z=2, threshold=0.5, once=True)
    q.awaitTermination(120)
    got = sorted((r.name, r["sample"], r.batch) for r in spark.read.parquet(f"{folder}/stream").collect())
    assert [x[:2] for x in got] == [("s1", "A"), ("s2", "B"), ("s3", "B")] and len({x[2] for x in got}) == 2


def test_params_are_part_of_the_fingerprint():
    from merlake.plans.catalog import fingerprint

    assert fingerprint(IndexParams(21)) == fingerprint(IndexParams(21)) != fingerprint(IndexParams(22))
