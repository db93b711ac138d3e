"""An HTTP service over a catalog: POST /query and GET /infos, with JSON and TSV answers."""

from __future__ import annotations

import json
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from ..operators.query import check_ratio, check_z, merge_records, query
from ..sources.sequences import literal_sequences, parse_payload, with_ids
from .catalog import Catalog, InvalidIndex


class InvalidRequest(ValueError):
    """A request that can't be answered as it stands."""


def parse_request(payload: str) -> dict:
    """The checked fields of a query request."""
    try:
        data = json.loads(payload)
    except ValueError as e:
        raise InvalidRequest(f"not JSON: {e}") from None
    if not isinstance(data, dict):
        raise InvalidRequest("the request must be an object")
    if not isinstance(data.get("index"), list) or not data["index"] or not all(isinstance(x, str) for x in data["index"]):
        raise InvalidRequest("index must be a list of names")
    if "id" not in data:
        raise InvalidRequest("id is missing")
    if ("seq" in data) == ("fastx" in data):
        raise InvalidRequest("give either seq or fastx")
    seqs = data.get("seq")
    if seqs is not None:
        seqs = [seqs] if isinstance(seqs, str) else seqs
        if not isinstance(seqs, list) or not seqs or not all(isinstance(s, str) for s in seqs):
            raise InvalidRequest("seq must be a list of sequences")
    if "z" not in data:
        raise InvalidRequest("z is missing")
    try:
        z, r = check_z(int(data["z"])), check_ratio(float(data.get("r", 0.0)))
    except (TypeError, ValueError) as e:
        raise InvalidRequest(str(e)) from None
    form = data.get("format", "json")
    if form not in ("json", "json_vec", "tsv"):
        raise InvalidRequest("format must be json, json_vec or tsv")
    return {"index": data["index"], "id": str(data["id"]), "seq": seqs, "fastx": data.get("fastx"), "z": z, "r": r, "format": form}


def answer(catalog: Catalog, request: dict) -> tuple[str, str]:
    """(content type, body): all sequences of a request are one logical query."""
    spark = catalog.spark
    seqs = literal_sequences(spark, request["id"], request["seq"]) if request["seq"] else parse_payload(spark, request["fastx"])
    seqs = with_ids(seqs).cache()
    out: dict = {}
    lines: list[str] = []
    vectors = request["format"] == "json_vec"
    try:
        total = seqs.count()
        if not total:
            raise InvalidRequest("no sequence")
        for name in request["index"]:
            entry = catalog.get(name)
            index, abundance = catalog.open(name), entry.params.bits > 1
            if request["format"] != "tsv" and not seqs.where(F.length("seq") < entry.params.k + request["z"]).isEmpty():
                raise InvalidRequest(f"a sequence is shorter than {entry.params.k + request['z']} bases")
            scores = query(index, seqs, request["z"], positions=vectors)
            merged = merge_records(scores.drop("name"), [], abundance, vectors)
            if total == 1 and vectors:
                merged = merged.withColumn("positions", F.element_at("positions", 1))
            rows = sorted(merged.collect(), key=lambda r: r["sample"])  # a row a sample
            if request["format"] == "tsv":
                by_sample = {r["sample"]: r["class"] if abundance else r["ratio"] for r in rows}
                lines += ["\t".join([name, *entry.samples]), "\t".join([f"{name}:{request['id']}", *(str(by_sample.get(s, 0)) for s in entry.samples)]), ""]
                continue
            kept = [r for r in rows if r["ratio"] >= request["r"]]
            if vectors:
                values = {r["sample"]: ({"C": r["class"]} if abundance else {}) | {"P": r["positions"], "R": r["ratio"]} for r in kept}
            else:
                values = {r["sample"]: r["class"] if abundance else r["ratio"] for r in kept}
            out[name] = {request["id"]: values}
    finally:
        seqs.unpersist()
    return ("text/csv", "\n".join(lines) + "\n") if request["format"] == "tsv" else ("application/json", json.dumps(out))


def handle_query(catalog: Catalog, payload: str) -> tuple[int, str, str]:
    """(status, content type, body): client errors are 400, all others 500."""
    try:
        return (200, *answer(catalog, parse_request(payload)))
    except (InvalidRequest, InvalidIndex) as e:
        return 400, "application/json", json.dumps({"error": str(e)})
    except Exception as e:  # the service goes on
        return 500, "application/json", json.dumps({"error": str(e).split("\n")[0]})


def make_server(catalog: Catalog, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, kind: str, body: str) -> None:
            data = body.encode()
            self.send_response(status)
            if "deflate" in self.headers.get("Accept-Encoding", ""):
                data = zlib.compress(data)
                self.send_header("Content-Encoding", "deflate")
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:
            if self.path.rstrip("/") != "/query":
                return self._send(404, "application/json", '{"error": "not found"}')
            size = int(self.headers.get("Content-Length", 0))
            return self._send(*handle_query(catalog, self.rfile.read(size).decode()))

        def do_GET(self) -> None:
            if self.path.rstrip("/") != "/infos":
                return self._send(404, "application/json", '{"error": "not found"}')
            return self._send(200, "application/json", json.dumps(catalog.infos(with_path=False)))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


