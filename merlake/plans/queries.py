"""The registered queries over the driver's tables, and their SQL.

Documents are the indexed sequences, with their source (or language) as the sample;
benchmark items and conversation turns are the queries.  Texts become letters of DNA by one
rule in both engines: lower case, only a to z, and each letter to one of ACGT in turn.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode
from ..functions.kmers import canonical_kmers, kmers, minimizer
from ..operators import index as ix
from ..operators import layout, merge, query, summary
from ..operators.index import Index, IndexParams
from ..sources import samples as sample_sources
from ..sources import sequences
from ..streaming import queries as streaming
from . import formats, service
from .catalog import Catalog

K, Z, M, PARTITIONS, WINDOW = 15, 4, 8, 4, 1 << 18
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BASES = ("ACGT" * 7)[:26]
EXACT = IndexParams(K, M, PARTITIONS, hash="md5")
BLOOM = IndexParams(K, M, PARTITIONS, WINDOW, hash="md5")
ABUNDANCE = IndexParams(K, M, PARTITIONS, bits=2, hash="md5")


def as_dna(text: str) -> Column:
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", ""), _LETTERS, _BASES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Dealt over the cores if the input has fewer splits, as one small file has; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str, sample: str = "source", where: str | None = None) -> tuple[DataFrame, list[str]]:
    """(sample_idx, seq) of all documents, and the samples' names in order."""
    docs = _table(spark, sf_dir, "documents").where(F.col(sample).isNotNull())
    docs = docs.where(where) if where else docs
    names = sorted(r[0] for r in docs.select(sample).distinct().collect())
    number = spark.createDataFrame(list(enumerate(names)), "sample_idx int, name string")
    texts = _spread(docs.select(F.col(sample).alias("name"), "text"))
    return texts.join(F.broadcast(number), "name").select("sample_idx", as_dna("text").alias("seq")), names


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, name, seq) of the benchmark's items."""
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("item"), "item_id").alias("name"), as_dna("text").alias("seq"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, name, seq) of the turns of conversations; name is the conversation."""
    rows = _table(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("qid"), F.col("conv_id").cast("string").alias("name"), as_dna("text").alias("seq"))


def _index(spark: SparkSession, sf_dir: str, params: IndexParams = EXACT, sample: str = "source", where: str | None = None) -> Index:
    docs, names = documents(spark, sf_dir, sample, where)
    return ix.build(docs, names, params)


_FORMS = {"exact": EXACT, "bloom": BLOOM, "abundance": ABUNDANCE}
_HALVES = ("lang in ('de', 'en')", "lang not in ('de', 'en')")
_catalogs: dict[tuple, Catalog] = {}


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The stored indexes of these documents, in the shared folder.

    Indexes are built whole and stored when a query first needs them, and later queries of the
    session open them again, as a catalog is used.  A table that has changed has a new catalog.
    """
    store = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    status = store.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(store)
    key = (spark.sparkContext.applicationId, sf_dir, status.getModificationTime(), status.getLen())
    if key not in _catalogs:
        _catalogs[key] = Catalog(spark, _scratch(spark, "catalog"))
    return _catalogs[key]


def _stored(spark: SparkSession, sf_dir: str, form: str = "exact", sample: str = "source", half: int | None = None) -> Index:
    """A whole index of the documents, stored and opened again."""
    catalog, name = _catalog(spark, sf_dir), f"{form}-{sample}" + ("" if half is None else f"-{half}")
    if not catalog.has(name):
        docs, names = documents(spark, sf_dir, sample, None if half is None else _HALVES[half])
        catalog.build(docs, names, name, _FORMS[form])
    return Catalog(spark, catalog.root).open(name)


_SCORES = ("qid", "sample", "nbk", "count", "round(ratio, 9) AS ratio")


def _ask(spark: SparkSession, sf_dir: str, z: int, form: str = "exact", threshold: float = 0.0, positions: bool = False, seqs: DataFrame | None = None, sample: str = "source") -> DataFrame:
    asked = items(spark, sf_dir) if seqs is None else seqs
    return query.query(_stored(spark, sf_dir, form, sample), asked, z, threshold, positions)


# ---------------------------------------------------------------- words and cells


def kmer_extract(spark, sf_dir):
    return kmers(items(spark, sf_dir), K, ["qid"]).select("qid", "pos", "kmer")


def kmer_canonical(spark, sf_dir):
    docs, names = documents(spark, sf_dir)
    return ix.count_kmers(docs, K).groupBy("sample_idx").agg(F.sum("n").alias("n_kmers"), F.count("*").alias("n_distinct"))


def kmer_packed(spark, sf_dir):
    own = kmers(items(spark, sf_dir), K, ["qid"])
    return own.select("qid", "pos", encode.packed(F.col("kmer")).alias("code"), encode.canonical_packed(F.col("kmer")).alias("canonical_code"), encode.revcomp(F.col("kmer")).alias("revcomp"))


def kmer_minimizer(spark, sf_dir):
    return canonical_kmers(items(spark, sf_dir), K, ["qid"]).select("qid", "pos", minimizer(F.col("kmer"), K, M).alias("minimizer"))


def kmer_partition(spark, sf_dir):
    docs, _ = documents(spark, sf_dir)
    distinct = ix.count_kmers(docs, K)
    return ix.with_key(distinct, EXACT).groupBy("sample_idx", "part").agg(F.count("*").alias("n_kmers"))


def kmer_hash_cell(spark, sf_dir):
    return ix.with_key(ix.words(items(spark, sf_dir), K, ["qid"]), BLOOM)


def kmer_count(spark, sf_dir):
    docs, _ = documents(spark, sf_dir)
    return ix.count_kmers(docs, K).groupBy("sample_idx", "n").agg(F.count("*").alias("n_kmers"))


def kmer_hardmin(spark, sf_dir):
    docs, _ = documents(spark, sf_dir)
    return ix.count_kmers(docs, K, hard_min=3).groupBy("sample_idx").agg(F.count("*").alias("n_kmers"), F.sum("n").alias("n_occurrences"))


def abundance_class(spark, sf_dir):
    docs, _ = documents(spark, sf_dir)
    classed = ix.count_kmers(docs, K).select("sample_idx", encode.abundance_class(F.col("n"), 3).alias("cls"))
    return classed.groupBy("sample_idx", "cls").agg(F.count("*").alias("n_kmers"))


# ---------------------------------------------------------------- indexes


def index_exact_pa(spark, sf_dir):
    return _index(spark, sf_dir).rows.groupBy("sample_idx", "part").agg(F.count("*").alias("n_keys"))


def index_bloom_pa(spark, sf_dir):
    rows = _index(spark, sf_dir, BLOOM).rows
    return rows.groupBy("sample_idx", "part").agg(F.count("*").alias("n_cells"), F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"))


def index_bloom_stats(spark, sf_dir):
    return ix.false_positive_rates(_index(spark, sf_dir, BLOOM)).select("sample_idx", "part", "cells", F.round("rate", 9).alias("rate"))


def index_abundance(spark, sf_dir):
    return _index(spark, sf_dir, ABUNDANCE).rows.groupBy("sample_idx", F.col("cls").cast("int").alias("cls")).agg(F.count("*").alias("n_keys"))


def index_masks(spark, sf_dir):
    """Presence as bit masks and back: the samples a key has, counted from the bits."""
    index = _index(spark, sf_dir)
    masks = ix.to_masks(index)
    return masks.groupBy("part", F.bit_count("mask").cast("int").alias("n_samples")).agg(F.count("*").alias("n_keys"))


# ---------------------------------------------------------------- queries


def query_pa_z0(spark, sf_dir):
    return _ask(spark, sf_dir, 0).selectExpr(*_SCORES)


def query_pa_z4(spark, sf_dir):
    return _ask(spark, sf_dir, Z).selectExpr(*_SCORES)


def query_pa_threshold(spark, sf_dir):
    return _ask(spark, sf_dir, Z, threshold=0.5).selectExpr(*_SCORES)


def query_pa_bloom(spark, sf_dir):
    return _ask(spark, sf_dir, Z, "bloom").selectExpr(*_SCORES)


def _joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), "")


def query_pa_positions(spark, sf_dir):
    return _ask(spark, sf_dir, Z, positions=True).select("qid", "sample", _joined("positions").alias("positions"))


def query_single_pa(spark, sf_dir):
    scores = _ask(spark, sf_dir, Z, seqs=turns(spark, sf_dir), sample="lang")
    return query.merge_records(scores, ["name"]).select("name", "sample", "records", "nbk", "count", F.round("ratio", 9).alias("ratio"))


def query_abs(spark, sf_dir):
    return _ask(spark, sf_dir, Z, "abundance").select("qid", "sample", "nbk", F.col("class").alias("cls"))


def query_abs_ratio(spark, sf_dir):
    return _ask(spark, sf_dir, Z, "abundance").selectExpr(*_SCORES)


def query_abs_positions(spark, sf_dir):
    return _ask(spark, sf_dir, Z, "abundance", positions=True).select("qid", "sample", _joined("positions").alias("positions"))


def query_single_abs(spark, sf_dir):
    scores = _ask(spark, sf_dir, Z, "abundance", seqs=turns(spark, sf_dir), sample="lang")
    return query.merge_records(scores, ["name"], abundance=True).select("name", "sample", "records", F.col("class").alias("cls"), F.round("ratio", 9).alias("ratio"))


def query_multi_index(spark, sf_dir):
    both = {"by_source": _stored(spark, sf_dir), "by_lang": _stored(spark, sf_dir, sample="lang")}
    return query.query_many(both, items(spark, sf_dir), Z).selectExpr("index", *_SCORES)


def _as_decimal(scores: DataFrame) -> DataFrame:
    """Ratios of six decimals, so that both engines write the same digits."""
    return scores.withColumns({"ratio": F.col("ratio").cast("decimal(7,6)"), "index": F.lit("docs")})


def query_jsonl(spark, sf_dir):
    scores = _as_decimal(_ask(spark, sf_dir, Z))
    return formats.to_jsonl(scores, 0.1).select("qid", "value")


def query_jsonl_abs(spark, sf_dir):
    scores = _as_decimal(_ask(spark, sf_dir, Z, "abundance"))
    return formats.to_jsonl(scores, 0.1, abundance=True).select("qid", "value")


def query_json(spark, sf_dir):
    return formats.to_json(_as_decimal(_ask(spark, sf_dir, Z)), 0.1)


def query_json_vec(spark, sf_dir):
    return formats.to_json(_as_decimal(_ask(spark, sf_dir, Z, positions=True)), 0.1, vectors=True)


def query_jsonl_vec(spark, sf_dir):
    scores = _as_decimal(_ask(spark, sf_dir, Z, positions=True))
    return formats.to_jsonl(scores, 0.1, vectors=True).select("qid", "value")


def query_json_abs(spark, sf_dir):
    return formats.to_json(_as_decimal(_ask(spark, sf_dir, Z, "abundance")), 0.1, abundance=True)


def query_json_vec_abs(spark, sf_dir):
    return formats.to_json(_as_decimal(_ask(spark, sf_dir, Z, "abundance", positions=True)), 0.1, abundance=True, vectors=True)


def query_jsonl_vec_abs(spark, sf_dir):
    scores = _as_decimal(_ask(spark, sf_dir, Z, "abundance", positions=True))
    return formats.to_jsonl(scores, 0.1, abundance=True, vectors=True).select("qid", "value")


def query_matrix(spark, sf_dir):
    index = _stored(spark, sf_dir)
    return formats.matrix_lines(_as_decimal(query.query(index, items(spark, sf_dir), Z)), list(index.samples), "docs")


def query_matrix_abs(spark, sf_dir):
    index = _stored(spark, sf_dir, "abundance")
    return formats.matrix_lines(_as_decimal(query.query(index, items(spark, sf_dir), Z)), list(index.samples), "docs", abundance=True)


def query_single_positions(spark, sf_dir):
    """The positions of all records of a conversation, a list a record."""
    scores = _ask(spark, sf_dir, Z, positions=True, seqs=turns(spark, sf_dir).where("qid < 50000000"), sample="lang")
    merged = query.merge_records(scores, ["name"], positions=True)
    return merged.select("name", "sample", "records", F.array_join(F.transform("positions", lambda p: _joined(p)), "|").alias("positions"))


def short_query_filter(spark, sf_dir):
    kept = query.long_enough(turns(spark, sf_dir), K, Z)
    return kept.select("qid", query.word_count(K, Z).alias("nbk"))


# ---------------------------------------------------------------- summaries, merges, catalog


def sum_index(spark, sf_dir):
    sums = summary.summarise(_index(spark, sf_dir, BLOOM))
    return sums.groupBy("part", "n_samples").agg(F.count("*").alias("n_cells"))


def sum_index_corrected(spark, sf_dir):
    sums = summary.summarise(_index(spark, sf_dir, BLOOM), 0.15)
    return sums.groupBy("part", "n_samples").agg(F.count("*").alias("n_cells"))


def sum_query(spark, sf_dir):
    """A stored summary, opened again and asked."""
    index = _stored(spark, sf_dir)
    catalog = Catalog(spark, _catalog(spark, sf_dir).root)
    if not catalog.get("exact-source").summary:
        catalog.summarise("exact-source")
        _catalog(spark, sf_dir).entries.update(catalog.entries)
    counts = summary.query_summary(index, catalog.sums("exact-source"), items(spark, sf_dir))
    return formats.summary_jsonl(counts, "docs")


def _merged(spark, sf_dir, form):
    """The two halves, by language, merged in the catalog and opened again."""
    catalog, name = _catalog(spark, sf_dir), f"{form}-merged"
    if not catalog.has(name):
        for half in (0, 1):
            _stored(spark, sf_dir, form, "lang", half)
        catalog.merge([f"{form}-lang-0", f"{form}-lang-1"], name)
    return Catalog(spark, catalog.root).open(name)


def merge_pa(spark, sf_dir):
    return query.query(_merged(spark, sf_dir, "exact"), items(spark, sf_dir), Z).selectExpr(*_SCORES)


def merge_abs(spark, sf_dir):
    return query.query(_merged(spark, sf_dir, "abundance"), items(spark, sf_dir), Z).select("qid", "sample", "count", F.col("class").alias("cls"))


def merge_rename_format(spark, sf_dir):
    parts = [_stored(spark, sf_dir, "exact", "source", half) for half in (0, 1)]
    return query.query(merge.merge(parts, form="S{}"), items(spark, sf_dir), Z).select("qid", "sample", "sample_idx", "count")


def merge_rename_ids(spark, sf_dir):
    """Samples renamed by a list of ids, a line each, written and read."""
    parts = [_stored(spark, sf_dir, "exact", "lang", half) for half in (0, 1)]
    path = _scratch(spark, "ids")
    n = sum(len(p.samples) for p in parts)
    spark.range(n).orderBy("id").coalesce(1).select(F.format_string("id-%d", "id")).write.text(path)
    merged = merge.merge(parts, ids=sample_sources.read_names(spark, f"@{path}"))
    return query.query(merged, items(spark, sf_dir), Z).select("qid", "sample", "sample_idx", "count")


def merge_conflicts(spark, sf_dir):
    parts = [_stored(spark, sf_dir, "exact", "source", half) for half in (0, 1)]
    return spark.createDataFrame([(s,) for s in merge.conflicts(parts)], "sample string")


def _small_catalog(spark, sf_dir):
    """A catalog of its own with indexes of the items' sequences, which are three samples in turn."""
    catalog = Catalog(spark, _scratch(spark, "small"))
    seqs = items(spark, sf_dir).select((F.col("qid") % 3).cast("int").alias("sample_idx"), "seq")
    for name, params in (("a", EXACT), ("b", BLOOM), ("a2", EXACT), ("d", ABUNDANCE), ("e", ABUNDANCE)):
        catalog.build(seqs, ["x", "y", "z"], name, params)
    return Catalog(spark, catalog.root)


def catalog_infos(spark, sf_dir):
    """The catalog of the stored indexes, read again."""
    for form in _FORMS:
        _stored(spark, sf_dir, form)
    infos = Catalog(spark, _catalog(spark, sf_dir).root).infos(False)["index"]
    rows = [(form, r["nb_samples"], r["smer_size"], r["minim_size"], r["nb_partitions"], r["bloom_size"], r["bw"], ",".join(r["samples"])) for form in sorted(_FORMS) for r in [infos[f"{form}-source"]]]
    return spark.createDataFrame(rows, "name string, nb_samples long, smer_size long, minim_size long, nb_partitions long, bloom_size long, bw long, samples string")


def mergeable_groups(spark, sf_dir):
    groups = _small_catalog(spark, sf_dir).mergeable()
    return spark.createDataFrame([(",".join(g), len(g)) for g in groups], "names string, n long")


def catalog_register(spark, sf_dir):
    """Indexes registered from a list of names and folders, as links and as copies; removing a link leaves its rows."""
    source, other = _small_catalog(spark, sf_dir), Catalog(spark, _scratch(spark, "other"))
    path = _scratch(spark, "list")
    spark.createDataFrame([("a", source.root), ("d", source.root)], "name string, path string").coalesce(1).write.csv(path, sep="\t")
    for r in sample_sources.read_registrations(spark, path).collect():
        for mode in ("symlink", "copy"):
            other.register(f"{r.name}-{mode}", Catalog(spark, r.path).get(r.name), mode)
    other.register("gone", source.get("a"), "symlink")
    other.remove("gone", delete=True)
    other = Catalog(spark, other.root)
    out = None
    for name in other.names():
        own = other.open(name).rows.groupBy("sample_idx").agg(F.count("*").alias("n_keys"), F.sum("cls").alias("classes")).withColumn("name", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out.select("name", "sample_idx", "n_keys", "classes")


def service_query(spark, sf_dir):
    """Two sequences as one query of the service, against two indexes."""
    _stored(spark, sf_dir, "exact", "lang"), _stored(spark, sf_dir, "exact", "source")
    catalog = Catalog(spark, _catalog(spark, sf_dir).root)
    seqs = [r.seq for r in items(spark, sf_dir).where("qid in (0, 1)").orderBy("qid").collect()]
    asked = json.dumps({"index": ["exact-lang", "exact-source"], "id": "two", "seq": seqs, "z": Z, "r": 0.1})
    status, _, body = service.handle_query(catalog, asked)
    rows = [(status, index, sample, round(ratio, 9)) for index, own in json.loads(body).items() for sample, ratio in own["two"].items()]
    return spark.createDataFrame(rows, "status long, index string, sample string, ratio double")


def payload_query(spark, sf_dir):
    """Sequences from a FASTA string, as the service is given them."""
    rows = items(spark, sf_dir).where(F.length("seq") > 0).orderBy("qid").collect()
    payload = "".join(f">{r.name} x\n{r.seq}\n" for r in rows)
    seqs = sequences.parse_payload(spark, payload).unionByName(sequences.literal_sequences(spark, "literal", [rows[0].seq]))
    return seqs.select("name", F.length("seq").alias("length"), F.md5(F.col("seq").cast("binary")).alias("digest"))


def streamed_query(spark, sf_dir):
    """Items that arrive as FASTA files, scored by micro-batches."""
    inbox, out = _scratch(spark, "inbox"), _scratch(spark, "scores")
    items(spark, sf_dir).where("seq <> ''").repartition(3).select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq")).write.text(inbox)
    asked = streaming.stream_query(_stored(spark, sf_dir, "exact", "lang"), streaming.stream_sequences(spark, inbox, 2), streaming.parquet_sink(out), _scratch(spark, "state"), Z, 0.2, True)
    asked.awaitTermination()
    return spark.read.parquet(out).select("name", "sample", "count", F.round("ratio", 9).alias("ratio"))


def packed_classes(spark, sf_dir):
    """Abundance classes packed into longs and back."""
    index = _stored(spark, sf_dir, "abundance", "lang")
    packed = ix.pack_classes(index)
    each = packed.select(F.posexplode(encode.unpacked(F.col("packed"), index.params.bits, len(index.samples))).alias("sample_idx", "cls"))
    return each.where("cls > 0").groupBy("sample_idx", "cls").agg(F.count("*").alias("n_keys"))


# ---------------------------------------------------------------- sources


def _scratch(spark: SparkSession, tag: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="merlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def source_fasta(spark, sf_dir):
    """Items written as FASTA of 60 letters a line, gzipped, and read back."""
    path = _scratch(spark, "fasta")
    lines = F.rtrim(F.regexp_replace("seq", "(.{60})", "$1\n"), F.lit("\n"))
    items(spark, sf_dir).where("seq <> ''").select(F.concat(F.lit(">"), "name", F.lit(" x\n"), lines)).write.text(path, compression="gzip")
    return sequences.read_fasta(spark, path).select("name", "seq")


def source_fastq(spark, sf_dir):
    path = _scratch(spark, "fastq")
    items(spark, sf_dir).where("seq <> ''").select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))).write.text(path)
    return sequences.read_fastq(spark, path).select("name", "seq")


def source_samples(spark, sf_dir):
    """A sample list of two files a sample, written and read."""
    path = _scratch(spark, "fof")
    names = _table(spark, sf_dir, "documents").select("source").distinct().orderBy("source")
    names.coalesce(1).sortWithinPartitions("source").select(F.concat("source", F.lit(": "), "source", F.lit("_1.fa ; "), "source", F.lit("_2.fa.gz"))).write.text(path)
    return sample_sources.read_sample_list(spark, path).select("sample_idx", "sample_id", F.array_join("files", "|").alias("files"))


# ---------------------------------------------------------------- without SQL


def random_fpr_estimate(spark, sf_dir):
    """Random words in the Bloom index: the mean share that is found is the false positive rate."""
    share = summary.estimate_correction(_stored(spark, sf_dir, "bloom"), 2_000, 7)
    return spark.createDataFrame([(float(share),)], "rate double")


def compress_roundtrip(spark, sf_dir):
    """An index rewritten with zstandard and in another order of samples answers the same."""
    asked = items(spark, sf_dir)
    stored = layout.rewrite(_stored(spark, sf_dir, "bloom"), _scratch(spark, "zstd"), similar=True, check=False)
    return query.query(stored, asked, Z).selectExpr(*_SCORES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        kmer_extract, kmer_canonical, kmer_packed, kmer_minimizer, kmer_partition, kmer_hash_cell, kmer_count, kmer_hardmin, abundance_class,
        index_exact_pa, index_bloom_pa, index_bloom_stats, index_abundance, index_masks,
        query_pa_z0, query_pa_z4, query_pa_threshold, query_pa_bloom, query_pa_positions, query_single_pa,
        query_abs, query_abs_ratio, query_abs_positions, query_single_abs, query_multi_index,
        query_jsonl, query_jsonl_vec, query_jsonl_abs, query_jsonl_vec_abs, query_json, query_json_vec, query_json_abs, query_json_vec_abs,
        query_matrix, query_matrix_abs, query_single_positions, short_query_filter, service_query, payload_query, streamed_query, packed_classes,
        sum_index, sum_index_corrected, sum_query, merge_pa, merge_abs, merge_rename_format, merge_rename_ids, merge_conflicts,
        catalog_infos, mergeable_groups, catalog_register,
        source_fasta, source_fastq, source_samples, random_fpr_estimate, compress_roundtrip,
    )
}


# ---------------------------------------------------------------- SQL


def _dna(text: str) -> str:
    return f"translate(regexp_replace(lower(coalesce({text}, '')), '[^a-z]', '', 'g'), '{_LETTERS}', '{_BASES}')"


def _words(source: str, keep: str) -> str:
    return f"(SELECT {keep}, p - 1 AS pos, substr(seq, p, {K}) AS w FROM (SELECT {keep}, seq, unnest(range(1, length(seq) - {K} + 2)) AS p FROM {source}))"


_CANON = "least(w, reverse(translate(w, 'ACGT', 'TGCA')))"


def _md5(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


_MIN = "least(" + ", ".join(f"substr({s}, {i}, {M})" for s in ("kmer", "reverse(translate(kmer, 'ACGT', 'TGCA'))") for i in range(1, K - M + 2)) + ")"
_PART = f"({_md5(_MIN)} % {PARTITIONS})"


def _docs(sample: str = "source", where: str = "true") -> str:
    return f"""docs AS (SELECT (dense_rank() OVER (ORDER BY {sample}) - 1)::INTEGER AS sample_idx, {sample} AS sample, {_dna('text')} AS seq FROM documents WHERE {sample} IS NOT NULL AND {where}),
        counted AS (SELECT sample_idx, sample, {_CANON} AS kmer, count(*) AS n FROM {_words('docs', 'sample_idx, sample')} GROUP BY ALL),
        samples AS (SELECT DISTINCT sample_idx, sample FROM docs)"""


_ITEMS = f"asked AS (SELECT item_id AS qid, 'item' || item_id AS name, {_dna('text')} AS seq FROM benchmark)"
_TURNS = f"asked AS (SELECT conv_id * 1000000 + turn AS qid, conv_id::VARCHAR AS name, {_dna('text')} AS seq FROM conversations)"
_OWN = f"own AS (SELECT qid, pos, {_CANON} AS kmer FROM {_words('asked', 'qid')})"
_PRESENT = "rel AS (SELECT sample_idx, kmer, 1 AS cls FROM counted)"
_CLASSED = "rel AS (SELECT sample_idx, kmer, least(length(bin(n)), 3) AS cls FROM counted)"
_CELL = f"({_md5('kmer')} % {WINDOW})"
_CELLS = f"cells AS (SELECT DISTINCT sample_idx, {_PART} AS part, {_CELL} AS cell FROM counted)"


def _scored(z: int, asked: str = _ITEMS, docs: str | None = None, rel: str = _PRESENT, bloom: bool = False) -> str:
    """CTEs up to scored (qid, name, sample_idx, sample, nbk, count, ratio, cls, positions), by dense windows."""
    if bloom:
        hit = f"""{_CELLS}, keyed AS (SELECT qid, pos, {_PART} AS part, {_CELL} AS cell FROM own),
        dense AS (SELECT k.qid, k.pos, s.sample_idx, CASE WHEN c.cell IS NULL THEN 0 ELSE 1 END AS cls
                  FROM keyed k CROSS JOIN samples s LEFT JOIN cells c ON c.part = k.part AND c.cell = k.cell AND c.sample_idx = s.sample_idx)"""
    else:
        hit = f"""{rel},
        dense AS (SELECT o.qid, o.pos, s.sample_idx, coalesce(r.cls, 0) AS cls
                  FROM own o CROSS JOIN samples s LEFT JOIN rel r ON r.kmer = o.kmer AND r.sample_idx = s.sample_idx)"""
    return f"""{docs or _docs()}, {asked}, {_OWN}, {hit},
        wide AS (SELECT qid, pos, sample_idx, min(cls) OVER (PARTITION BY qid, sample_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND {z} FOLLOWING) AS cls FROM dense),
        kept AS (SELECT qid, name, length(seq) - {K} + 1 - {z} AS nbk FROM asked WHERE length(seq) >= {K + z}),
        scored AS (SELECT w.qid, k.name, w.sample_idx, s.sample, k.nbk, count(*) FILTER (cls > 0) AS count, count(*) FILTER (cls > 0) / k.nbk AS ratio,
                          (sum(cls)::BIGINT // k.nbk)::INTEGER AS cls, string_agg(cls::VARCHAR, '' ORDER BY pos) AS positions
                   FROM wide w JOIN kept k ON k.qid = w.qid AND w.pos < k.nbk JOIN samples s ON s.sample_idx = w.sample_idx
                   GROUP BY w.qid, k.name, w.sample_idx, s.sample, k.nbk)"""


_OUT = "qid, sample, nbk, count, round(ratio, 9) AS ratio"
_DEC = "CAST(CAST(round(ratio, 6) AS DECIMAL(7,6)) AS VARCHAR)"


def _json_map(value: str, keep: str = "ratio >= 0.1") -> str:
    return f"'{{' || coalesce(string_agg('\"' || sample || '\":' || {value}, ',' ORDER BY sample) FILTER ({keep}), '') || '}}'"


_MAP, _MAP_ABS = _json_map(_DEC), _json_map("cls::VARCHAR")
_POS = "array_to_string(string_split(positions, ''), ',')"
_MAP_LINES = _json_map("cls::VARCHAR", "true")
_MAP_VEC_ABS = _json_map("'{\"C\":' || cls || ',\"P\":[' || " + _POS + " || '],\"R\":' || " + _DEC + " || '}'")
_MAP_VEC_LINES = _json_map("'{\"C\":' || cls || ',\"P\":[' || " + _POS + " || ']}'", "true")
_MAP_VEC = _json_map("'{\"P\":[' || array_to_string(string_split(positions, ''), ',') || '],\"R\":' || " + _DEC + " || '}'")

SQL: dict[str, str] = {
    "kmer_extract": f"WITH {_ITEMS} SELECT qid, pos, w AS kmer FROM {_words('asked', 'qid')}",
    "kmer_canonical": f"WITH {_docs()} SELECT sample_idx, sum(n)::BIGINT AS n_kmers, count(*) AS n_distinct FROM counted GROUP BY 1",
    "kmer_packed": f"""WITH {_ITEMS}, w AS (SELECT qid, pos, w, reverse(translate(w, 'ACGT', 'TGCA')) AS rc FROM {_words('asked', 'qid')}),
        c AS (SELECT qid, pos, rc, list_reduce(list_transform(string_split(translate(w, 'ACTG', '0123'), ''), lambda x: x::BIGINT), lambda a, b: a * 4 + b) AS f,
                     list_reduce(list_transform(string_split(translate(rc, 'ACTG', '0123'), ''), lambda x: x::BIGINT), lambda a, b: a * 4 + b) AS r FROM w)
        SELECT qid, pos, f AS code, least(f, r) AS canonical_code, rc AS revcomp FROM c""",
    "kmer_minimizer": f"WITH {_ITEMS}, {_OWN} SELECT qid, pos, {_MIN} AS minimizer FROM own",
    "kmer_partition": f"WITH {_docs()} SELECT sample_idx, {_PART}::INTEGER AS part, count(*) AS n_kmers FROM counted GROUP BY ALL",
    "kmer_hash_cell": f"WITH {_ITEMS}, {_OWN} SELECT qid, pos, {_PART}::INTEGER AS part, {_CELL} AS cell FROM own",
    "kmer_count": f"WITH {_docs()} SELECT sample_idx, n, count(*) AS n_kmers FROM counted GROUP BY ALL",
    "kmer_hardmin": f"WITH {_docs()} SELECT sample_idx, count(*) AS n_kmers, sum(n)::BIGINT AS n_occurrences FROM counted WHERE n >= 3 GROUP BY 1",
    "abundance_class": f"WITH {_docs()} SELECT sample_idx, least(length(bin(n)), 7)::INTEGER AS cls, count(*) AS n_kmers FROM counted GROUP BY ALL",
    "index_exact_pa": f"WITH {_docs()} SELECT sample_idx, {_PART}::INTEGER AS part, count(*) AS n_keys FROM counted GROUP BY ALL",
    "index_bloom_pa": f"WITH {_docs()}, {_CELLS} SELECT sample_idx, part::INTEGER AS part, count(*) AS n_cells, min(cell) AS first_cell, max(cell) AS last_cell FROM cells GROUP BY ALL",
    "index_bloom_stats": f"WITH {_docs()}, {_CELLS} SELECT sample_idx, part::INTEGER AS part, count(*) AS cells, round(count(*) / {float(WINDOW)}, 9) AS rate FROM cells GROUP BY ALL",
    "index_abundance": f"WITH {_docs()} SELECT sample_idx, least(length(bin(n)), 3)::INTEGER AS cls, count(*) AS n_keys FROM counted GROUP BY ALL",
    "index_masks": f"WITH {_docs()}, k AS (SELECT {_PART}::INTEGER AS part, kmer, count(*)::INTEGER AS n_samples FROM counted GROUP BY ALL) SELECT part, n_samples, count(*) AS n_keys FROM k GROUP BY ALL",
    "query_pa_z0": f"WITH {_scored(0)} SELECT {_OUT} FROM scored",
    "query_pa_z4": f"WITH {_scored(Z)} SELECT {_OUT} FROM scored",
    "query_pa_threshold": f"WITH {_scored(Z)} SELECT {_OUT} FROM scored WHERE ratio >= 0.5",
    "query_pa_bloom": f"WITH {_scored(Z, bloom=True)} SELECT {_OUT} FROM scored",
    "query_pa_positions": f"WITH {_scored(Z)} SELECT qid, sample, positions FROM scored",
    "query_single_pa": f"WITH {_scored(Z, _TURNS, _docs('lang'))} SELECT name, sample, count(*) AS records, sum(nbk)::BIGINT AS nbk, sum(count)::BIGINT AS count, round(sum(count) / sum(nbk), 9) AS ratio FROM scored GROUP BY name, sample",
    "query_abs": f"WITH {_scored(Z, rel=_CLASSED)} SELECT qid, sample, nbk, cls FROM scored",
    "query_abs_ratio": f"WITH {_scored(Z, rel=_CLASSED)} SELECT {_OUT} FROM scored",
    "query_abs_positions": f"WITH {_scored(Z, rel=_CLASSED)} SELECT qid, sample, positions FROM scored",
    "query_single_abs": f"WITH {_scored(Z, _TURNS, _docs('lang'), _CLASSED)} SELECT name, sample, count(*) AS records, (sum(cls)::BIGINT // count(*))::INTEGER AS cls, round(avg(ratio), 9) AS ratio FROM scored GROUP BY name, sample",
    "query_multi_index": f"SELECT 'by_source' AS index, * FROM (WITH {_scored(Z)} SELECT {_OUT} FROM scored) UNION ALL SELECT 'by_lang' AS index, * FROM (WITH {_scored(Z, docs=_docs('lang'))} SELECT {_OUT} FROM scored)",
    "query_jsonl": f"""WITH {_scored(Z)} SELECT qid, '{{"index":"docs","query":"' || name || '","samples":' || {_MAP} || '}}' AS value FROM scored GROUP BY qid, name""",
    "query_jsonl_abs": f"""WITH {_scored(Z, rel=_CLASSED)} SELECT qid, '{{"index":"docs","query":"' || name || '","samples":' || {_MAP_LINES} || '}}' AS value FROM scored GROUP BY qid, name""",
    "query_json": f"""WITH {_scored(Z)}, q AS (SELECT name, '"' || name || '":' || {_MAP} AS v FROM scored GROUP BY qid, name) SELECT 'docs' AS index, '{{"docs":{{' || string_agg(v, ',' ORDER BY name) || '}}}}' AS value FROM q""",
    "query_json_vec": f"""WITH {_scored(Z)}, q AS (SELECT name, '"' || name || '":' || {_MAP_VEC} AS v FROM scored GROUP BY qid, name) SELECT 'docs' AS index, '{{"docs":{{' || string_agg(v, ',' ORDER BY name) || '}}}}' AS value FROM q""",
    "query_jsonl_vec": f"""WITH {_scored(Z)} SELECT qid, '{{"index":"docs","query":"' || name || '","samples":' || {_MAP_VEC} || '}}' AS value FROM scored GROUP BY qid, name""",
    "query_json_abs": f"""WITH {_scored(Z, rel=_CLASSED)}, q AS (SELECT name, '"' || name || '":' || {_MAP_ABS} AS v FROM scored GROUP BY qid, name) SELECT 'docs' AS index, '{{"docs":{{' || string_agg(v, ',' ORDER BY name) || '}}}}' AS value FROM q""",
    "query_json_vec_abs": f"""WITH {_scored(Z, rel=_CLASSED)}, q AS (SELECT name, '"' || name || '":' || {_MAP_VEC_ABS} AS v FROM scored GROUP BY qid, name) SELECT 'docs' AS index, '{{"docs":{{' || string_agg(v, ',' ORDER BY name) || '}}}}' AS value FROM q""",
    "query_jsonl_vec_abs": f"""WITH {_scored(Z, rel=_CLASSED)} SELECT qid, '{{"index":"docs","query":"' || name || '","samples":' || {_MAP_VEC_LINES} || '}}' AS value FROM scored GROUP BY qid, name""",
    "query_matrix": f"WITH {_scored(Z)} SELECT -1 AS qid, 'docs' || chr(9) || string_agg(sample, chr(9) ORDER BY sample) AS value FROM samples UNION ALL SELECT qid, 'docs:' || name || chr(9) || string_agg({_DEC}, chr(9) ORDER BY sample_idx) FROM scored GROUP BY qid, name",
    "query_matrix_abs": f"WITH {_scored(Z, rel=_CLASSED)} SELECT -1 AS qid, 'docs' || chr(9) || string_agg(sample, chr(9) ORDER BY sample) AS value FROM samples UNION ALL SELECT qid, 'docs:' || name || chr(9) || string_agg(cls::VARCHAR, chr(9) ORDER BY sample_idx) FROM scored GROUP BY qid, name",
    "short_query_filter": f"WITH {_TURNS} SELECT qid, length(seq) - {K} + 1 - {Z} AS nbk FROM asked WHERE length(seq) >= {K + Z}",
    "sum_index": f"WITH {_docs()}, {_CELLS}, k AS (SELECT part::INTEGER AS part, cell, count(*) AS n_samples FROM cells GROUP BY ALL) SELECT part, n_samples, count(*) AS n_cells FROM k GROUP BY ALL",
    "sum_index_corrected": f"WITH {_docs()}, {_CELLS}, k AS (SELECT part::INTEGER AS part, cell, greatest(0, round(count(*) - 0.15::DOUBLE * (SELECT count(*) FROM samples)))::BIGINT AS n_samples FROM cells GROUP BY ALL) SELECT part, n_samples, count(*) AS n_cells FROM k GROUP BY ALL",
    "sum_query": f"""WITH {_docs()}, {_ITEMS}, {_OWN}, s AS (SELECT kmer, count(*) AS n FROM counted GROUP BY 1)
        SELECT o.qid, '{{"index":"docs","query":"item' || o.qid || '","abs":[' || string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY pos) || ']}}' AS value
        FROM own o JOIN asked a ON a.qid = o.qid AND length(a.seq) >= {K + 1} LEFT JOIN s ON s.kmer = o.kmer GROUP BY o.qid""",
    "merge_pa": f"WITH {_scored(Z, docs=_docs('lang'))} SELECT {_OUT} FROM scored",
    "merge_abs": f"WITH {_scored(Z, docs=_docs('lang'), rel=_CLASSED)} SELECT qid, sample, count, cls FROM scored",
    "merge_rename_format": f"""WITH a AS (WITH {_scored(Z, docs=_docs(where=_HALVES[0]))} SELECT qid, sample_idx, count FROM scored),
        b AS (WITH {_scored(Z, docs=_docs(where=_HALVES[1]))} SELECT qid, sample_idx, count FROM scored),
        n AS (SELECT count(DISTINCT source) AS n FROM documents WHERE {_HALVES[0]}),
        u AS (SELECT * FROM a UNION ALL SELECT qid, sample_idx + n, count FROM b, n)
        SELECT qid, 'S' || sample_idx AS sample, sample_idx::INTEGER AS sample_idx, count FROM u""",
    "merge_conflicts": f"SELECT source AS sample FROM documents WHERE {_HALVES[0]} INTERSECT SELECT source FROM documents WHERE {_HALVES[1]}",
    "catalog_infos": f"""WITH s AS (SELECT count(DISTINCT source) AS nb_samples, string_agg(DISTINCT source, ',' ORDER BY source) AS samples FROM documents),
        p(name, bloom_size, bw) AS (VALUES ('abundance', 0, 2), ('bloom', {WINDOW * PARTITIONS}, 1), ('exact', 0, 1))
        SELECT name, nb_samples, {K}::BIGINT AS smer_size, {M}::BIGINT AS minim_size, {PARTITIONS}::BIGINT AS nb_partitions, bloom_size::BIGINT AS bloom_size, bw::BIGINT AS bw, samples FROM p, s""",
    "mergeable_groups": "SELECT string_agg(name, ',' ORDER BY name) AS names, count(*) AS n FROM (VALUES ('a', 15, 0, 1), ('b', 15, 262144, 1), ('a2', 15, 0, 1), ('d', 15, 0, 2), ('e', 15, 0, 2)) t(name, k, cells, bits) GROUP BY k, cells, bits HAVING count(*) > 1",
    "query_single_positions": f"WITH {_scored(Z, _TURNS.replace('FROM conversations', 'FROM conversations WHERE conv_id * 1000000 + turn < 50000000'), _docs('lang'))} SELECT name, sample, count(*) AS records, string_agg(positions, '|' ORDER BY qid) AS positions FROM scored GROUP BY name, sample",
    "service_query": f"""WITH a AS (WITH {_scored(Z, _ITEMS, _docs('lang'))} SELECT 'exact-lang' AS index, sample, sum(count) / sum(nbk) AS ratio FROM scored WHERE qid IN (0, 1) GROUP BY sample),
        b AS (WITH {_scored(Z)} SELECT 'exact-source' AS index, sample, sum(count) / sum(nbk) AS ratio FROM scored WHERE qid IN (0, 1) GROUP BY sample)
        SELECT 200::BIGINT AS status, index, sample, round(ratio, 9) AS ratio FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE ratio >= 0.1""",
    "payload_query": f"WITH {_ITEMS}, s AS (SELECT name, seq FROM asked WHERE seq <> '' UNION ALL SELECT 'literal', seq FROM (SELECT seq FROM asked WHERE seq <> '' ORDER BY qid LIMIT 1)) SELECT name, length(seq)::INTEGER AS length, md5(seq) AS digest FROM s",
    "streamed_query": f"WITH {_scored(Z, _ITEMS, _docs('lang'))} SELECT name, sample, count, round(ratio, 9) AS ratio FROM scored WHERE ratio >= 0.2",
    "packed_classes": f"WITH {_docs('lang')} SELECT sample_idx, least(length(bin(n)), 3)::INTEGER AS cls, count(*) AS n_keys FROM counted GROUP BY ALL",
    "merge_rename_ids": f"WITH {_scored(Z, docs=_docs('lang'))} SELECT qid, 'id-' || sample_idx AS sample, sample_idx, count FROM scored",
    "catalog_register": f"""WITH {_ITEMS}, {_OWN}, k AS (SELECT (qid % 3)::INTEGER AS sample_idx, kmer, count(*) AS n FROM own GROUP BY ALL),
        t AS (SELECT sample_idx, count(*) AS n_keys, count(*) AS ones, sum(least(length(bin(n)), 3))::BIGINT AS many FROM k GROUP BY 1)
        SELECT name, sample_idx, n_keys, CASE WHEN abundance THEN many ELSE ones END AS classes
        FROM t, (VALUES ('a-copy', false), ('a-symlink', false), ('d-copy', true), ('d-symlink', true)) v(name, abundance)""",
    "source_fasta": f"WITH {_ITEMS} SELECT name, seq FROM asked WHERE seq <> ''",
    "source_fastq": f"WITH {_ITEMS} SELECT name, seq FROM asked WHERE seq <> ''",
    "source_samples": "SELECT (row_number() OVER (ORDER BY source) - 1)::INTEGER AS sample_idx, source AS sample_id, source || '_1.fa|' || source || '_2.fa.gz' AS files FROM (SELECT DISTINCT source FROM documents)",
    "compress_roundtrip": f"WITH {_scored(Z, bloom=True)} SELECT {_OUT} FROM scored",
}
