"""WARC archives: a writer, a normaliser of monolithic gzip files, and an indexed reader.

An archive that was compressed as one gzip stream can only be read from its start.  The
normaliser inflates such a stream once, rewrites every record as a gzip member of its own,
and writes a sidecar index with each member's offset and length, after which any record can
be read alone.  Files live in the shared folder and are written through pyarrow's file
systems, so any store that has one will do.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, new_path, remove

_BLOCK = 1 << 20
#: Revisits that are sent to every task; each takes about 100 bytes there.
BROADCAST_ROWS = 200_000
#: Groups of archives that are normalised, and whose monoliths are deleted, one after the other.
WAVES = 4


# ---------------------------------------------------------------- records


def record(kind: str, page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record.  A revisit has the HTTP header of the whole payload but no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{page_id}/{digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(url: str) -> str:
    """Control characters and spaces, which no valid URL has, as percent codes."""
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case; the version line as '') and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't match its header")
    return fields, block


def split_records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a stream of inflated blocks into whole records; holds one record at a time."""
    held, need = bytearray(), None
    for block in blocks:
        held += block
        while True:
            if need is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", bytes(held[:at]).replace(b"\r\n", b"\n"))
                if not held.startswith(b"WARC/") or not found:
                    raise ValueError("not a WARC record")
                need = at + 4 + int(found[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends inside a record")


# ---------------------------------------------------------------- files


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, read once from its start.

    A file that ends inside a member is an error, even where a record ends there.
    """
    tool, inside = zlib.decompressobj(31), False
    while raw := source.read(_BLOCK):
        full = True
        while raw or full:
            out = tool.decompress(raw, _BLOCK)
            full = len(out) == _BLOCK  # the tool may hold more
            inside = True
            if out:
                yield out
            raw = tool.unconsumed_tail
            if tool.eof:
                raw, tool, inside, full = tool.unused_data, zlib.decompressobj(31), False, False
    if inside:
        raise ValueError("the archive ends inside a gzip member")


def write_monolithic(path: str, records: Iterator[bytes], level: int = 1) -> int:
    """Write records as one gzip stream; returns their number."""
    store, at = _open(path)
    store.create_dir(posixpath.dirname(at), recursive=True)
    tool, n = zlib.compressobj(level, zlib.DEFLATED, 31), 0
    with store.open_output_stream(at, compression=None) as out:
        for data in records:
            out.write(tool.compress(data))
            n += 1
        out.write(tool.flush())
    return n


def normalise(source: str, target: str, level: int = 1) -> int:
    """Rewrite an archive with a member a record, and ``target`` + '.idx' with their places.

    The index has a JSON line a record: offset, length, kind and page.  Memory holds one
    record and one block of input.
    """
    store, at = _open(source)
    out_store, out_at = _open(target)
    offset = n = 0
    with store.open_input_stream(at, compression=None) as f, out_store.open_output_stream(out_at, compression=None) as out, out_store.open_output_stream(out_at + ".idx", compression=None) as index:
        for data in split_records(inflate(f)):
            tool = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = tool.compress(data) + tool.flush()
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[: data.find(b"\r\n\r\n")].decode().split("\r\n")[1:])}
            page = fields.get("warc-page-id")
            index.write(json.dumps({"offset": offset, "length": len(member), "kind": fields["warc-type"], "page": int(page) if page else None}).encode() + b"\n")
            out.write(member)
            offset += len(member)
            n += 1
    return n


def read_at(path: str, places: Iterator[tuple[int, int]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records at (offset, length) of a normalised archive."""
    store, at = _open(path)
    with store.open_input_file(at) as f:
        for offset, length in places:
            f.seek(offset)
            yield parse(zlib.decompress(f.read(length), 31))


def read_index(path: str) -> Iterator[dict]:
    store, at = _open(path + ".idx")
    with store.open_input_stream(at, compression=None) as f:
        held = b""
        while raw := f.read(_BLOCK):
            *lines, held = (held + raw).split(b"\n")
            yield from map(json.loads, lines)


# ---------------------------------------------------------------- DataFrames


def plan_records(pages: DataFrame, min_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, html, digest, size, refers_to): what to write for each page.

    Only (id, digest) pairs are compared.  Up to ``broadcast_rows`` revisits are sent to the
    tasks that read the pages, whose html then is not shuffled at all; more of them are
    joined by page.
    """
    data = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha2(data, 256).alias("digest"), F.octet_length(data).cast("long").alias("size"))
    slim = rows.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", F.unhex("digest").alias("digest"))
    slim = materialise(slim, "digests")
    groups = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = slim.join(groups, "digest").where("page_id > first").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers_to")).distinct()
    revisits = materialise(revisits, "revisits")
    discard(slim)
    few = revisits.limit(broadcast_rows + 1).count() <= broadcast_rows
    return rows.join(F.broadcast(revisits) if few else revisits, (F.col("page_id") == F.col("p")) & (F.unhex("digest") == F.col("d")), "left").drop("p", "d")


def write_archives(plan: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write one monolithic archive a task; returns the manifest (path, n).

    The files' names are new for every attempt of a task, and only those of the attempt
    that succeeded are in the manifest, so a task that is run again leaves nothing wrong.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                page, url, html, digest, size, refers = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "digest", "size", "refers_to"))
                for k in range(batch.num_rows):
                    first = refers[k].as_py()
                    payload = (html[k].as_py() or "").encode() if first is None else None
                    yield record("response" if first is None else "revisit", page[k].as_py(), url[k].as_py(), payload, digest[k].as_py(), size[k].as_py(), first)

        path = f"{folder}/whole-{uuid.uuid4().hex}.warc.gz"
        n = write_monolithic(path, records(), level)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n"])

    return materialise(plan.mapInArrow(run, "path string, n long").where("n > 0"), "archives")


def normalise_archives(manifest: DataFrame, level: int = 1, waves: int = 1, delete: bool = False) -> DataFrame:
    """Normalise every archive of a manifest; returns the manifest of the new ones.

    The archives are taken in ``waves``.  With ``delete``, a wave's sources are deleted once
    the manifest of its targets is stored, so that only one wave's archives are there twice.
    Until then a task that is lost finds its source again.
    """
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{posixpath.dirname(source)}/{uuid.uuid4().hex}.warc.gz"
                n = normalise(source, target, level)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], names=["path", "n"])

    paths = sorted(r.path for r in manifest.select("path").collect())  # a row an archive, so a row a task
    out = None
    for wave in range(max(1, waves)):
        if own := paths[wave :: max(1, waves)]:
            listed = _listed(spark, own).mapInArrow(run, "path string, n long")
            done = materialise(listed, "normalised")
            out = done if out is None else out.unionByName(done)
            for path in own if delete else []:
                remove(spark, path)
    return manifest.limit(0) if out is None else out


def _listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A table of paths, one a task."""
    return spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1).repartition(len(paths))


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records.

    The digest of a response is taken from its payload anew and must match its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out: list[list] = [[] for _ in names]
                held = 0
                for fields, block in read_at(path, ((x["offset"], x["length"]) for x in read_index(path))):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    response = fields["warc-type"] == "response"
                    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: a payload doesn't match its digest")
                    page, refers = fields.get("warc-page-id"), fields.get("warc-refers-to-page")
                    for column, value in zip(out, (int(page) if page else None, fields.get("warc-target-uri"), size, digest, fields["warc-type"], int(refers) if refers else None, payload if response else None), strict=True):
                        column.append(value)
                    held += len(payload)
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
                        out, held = [[] for _ in names], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    paths = [r.path for r in manifest.select("path").collect()]  # a row an archive
    spread = _listed(manifest.sparkSession, paths) if paths else manifest.select("path")
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def roundtrip(pages: DataFrame, min_bytes: int = 100, level: int = 1, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to monolithic archives, normalise those, and read the records back.

    Of payloads of at least ``min_bytes`` that are equal, the one with the smallest id is a
    response and the others revisit it; smaller ones are all responses.  A null html is an
    empty payload.  A page with a null id is always a response, as nothing could refer to
    it.  Rows that repeat both id and html are one capture stored several times and all get
    the same kind.  Other columns are ignored; an empty table gives no rows.
    """
    folder = new_path(pages.sparkSession, "warc")
    plan = plan_records(pages, min_bytes, id_col, url_col, html_col)
    return read_archives(normalise_archives(write_archives(plan, folder, level), level, WAVES, delete=True))
