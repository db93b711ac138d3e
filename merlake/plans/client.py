"""A client of the service: single queries and batches, waiting or not."""

from __future__ import annotations

import asyncio
import json
import urllib.error
import urllib.request
from dataclasses import dataclass, field


@dataclass
class Query:
    """A logical query of one or more sequences against one or more indexes."""

    qid: str
    sequence: str | list[str]
    index: str | list[str]
    r: float = 0.0
    z: int = 3
    format: str = "json"

    def payload(self) -> dict:
        as_list = lambda x: [x] if isinstance(x, str) else list(x)
        return {"id": self.qid, "seq": as_list(self.sequence), "index": as_list(self.index), "r": self.r, "z": self.z, "format": self.format}


@dataclass
class Batch:
    """Queries that are sent together; those that fail don't stop the others."""

    queries: list[Query] = field(default_factory=list)

    def add(self, query: Query) -> Batch:
        self.queries.append(query)
        return self

    push = add


@dataclass
class Response:
    status: int
    body: str

    @property
    def ok(self) -> bool:
        return self.status == 200

    def json(self) -> dict:
        return json.loads(self.body)

    def samples(self, index: str, qid: str) -> dict:
        return self.json()[index][qid]


class Client:
    def __init__(self, host: str = "127.0.0.1", port: int = 8080, timeout: float = 600.0):
        self.base, self.timeout = f"http://{host}:{port}", timeout

    def _call(self, path: str, data: bytes | None = None) -> Response:
        request = urllib.request.Request(self.base + path, data=data, headers={"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return Response(r.status, r.read().decode())
        except urllib.error.HTTPError as e:
            return Response(e.code, e.read().decode())

    def infos(self) -> dict:
        return self._call("/infos").json()

    def submit(self, what: Query | Batch) -> Response | list[Response]:
        if isinstance(what, Batch):
            return [self.submit(q) for q in what.queries]
        return self._call("/query", json.dumps(what.payload()).encode())

    async def submit_async(self, what: Query | Batch) -> Response | list[Response]:
        if isinstance(what, Batch):
            return list(await asyncio.gather(*(self.submit_async(q) for q in what.queries)))
        return await asyncio.to_thread(self.submit, what)
