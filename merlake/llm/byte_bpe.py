"""Byte-level BPE as a finite-state transducer, and a streaming decoder.

The merges of a rank file are compiled into a transducer over bytes whose states are made
when they are first reached (lazy determinisation).  The encoding of a prefix is fixed by
its last token, and the last token is the one suffix that fits the encoding of what stands
before it, so it is enough to know, for the cuts inside the longest suffix that can still
grow into a token, which tokens are pending there.  Tokens on which all those cuts agree are
emitted, so the lookahead is bounded by the longest token.

Memory is bounded: a full table of states takes no more, and the states that it lacks are
made for one step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Suffix:
    """A string that may still grow into a token, as a node of the input automaton.

    ``cuts`` are the offsets where a token can start that reaches beyond the end (the end is
    one).  A move by a byte has the tokens that it can complete, as (cut, token), the cuts
    that stay alive, and the next suffix.
    """

    __slots__ = ("text", "cuts", "moves")

    def __init__(self, text: bytes, cuts: tuple[int, ...]):
        self.text, self.cuts = text, cuts
        self.moves: dict[int, tuple[tuple, tuple, _Suffix]] = {}


class _State:
    """A state of the transducer: a suffix, and at each of its cuts the last and the pending tokens."""

    __slots__ = ("suffix", "last", "pending", "kept", "next")

    def __init__(self, suffix: _Suffix, last: tuple, pending: tuple, kept: bool):
        self.suffix, self.last, self.pending, self.kept = suffix, last, pending, kept
        self.next: dict[int, tuple[_State, tuple[int, ...]]] = {}


class MergeTransducer:
    """Encodes byte strings with the merges of ``ranks``, every single byte being a token.

    At most ``max_states`` states are kept; beyond that, states that are not in the table
    are made for the step at hand only.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 60_000, max_pairs: int = 1_000_000):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must have a rank")
        self.ranks, self.max_states, self.max_pairs = ranks, max_states, max_pairs
        self.tokens = {i: t for t, i in ranks.items()}
        self.growing = {t[:k] for t in ranks for k in range(1, len(t))}
        self.halves = {t: self._halves(t) for t in ranks}
        self.spines: dict[tuple[int, int], list[tuple[bytes, float, float]]] = {}
        self.pairs: dict[int, bool] = {}
        self.suffixes: dict[bytes, _Suffix] = {}
        self.states: dict[tuple, _State] = {}
        self.start = self._state(self._suffix(b"", (0,)), (None,), ((),))

    def _halves(self, token: bytes) -> tuple[bytes, ...]:
        """What the last merge of the token's own encoding joins; more than two parts if none does."""
        own = [token[i : i + 1] for i in range(len(token))]
        while len(own) > 2:
            rank, at = min((self.ranks.get(own[i] + own[i + 1], 1 << 60), i) for i in range(len(own) - 1))
            if rank == 1 << 60:
                break
            own[at : at + 2] = [own[at] + own[at + 1]]
        return tuple(own)

    def _spine(self, token: int, side: int) -> list[tuple[bytes, float, float]]:
        """The parts that stand at the token's right (-1) or left (0) end while it is merged:
        each with the ranks at which it appears and is used up."""
        found = self.spines.get((token, side))
        if found is None:
            part, end, found = self.tokens[token], float("inf"), []
            while True:
                born = self.ranks[part] if len(part) > 1 else -1
                found.append((part, born, end))
                if len(part) == 1:
                    break
                end, part = born, self.halves[part][side]
            self.spines[token, side] = found
        return found

    def _fit(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when one follows the other.

        They don't if some merge across the boundary comes before the merges that use up the
        two parts there; of equal ranks the leftmost merge is first.
        """
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            found = True
            for x, born_x, end_x in self._spine(left, -1):
                for y, born_y, end_y in self._spine(right, 0):
                    rank = self.ranks.get(x + y)
                    if rank is not None and max(born_x, born_y, rank) < end_x and max(born_x, born_y) < end_y and rank <= end_y:
                        found = False
                        break
                if not found:
                    break
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def _suffix(self, text: bytes, cuts: tuple[int, ...]) -> _Suffix:
        found = self.suffixes.get(text)
        if found is None:
            found = self.suffixes[text] = _Suffix(text, cuts)
        return found

    def _move(self, suffix: _Suffix, byte: int) -> tuple[tuple, tuple, _Suffix]:
        text = suffix.text + bytes([byte])
        done = tuple((k, self.ranks[text[c:]]) for k, c in enumerate(suffix.cuts) if len(self.halves.get(text[c:], "...")) < 3)
        kept = tuple(k for k, c in enumerate(suffix.cuts) if text[c:] in self.growing)
        cuts = [suffix.cuts[k] for k in kept] + [len(text)]
        found = suffix.moves[byte] = (done, kept, self._suffix(text[cuts[0] :], tuple(c - cuts[0] for c in cuts)))
        return found

    def _state(self, suffix: _Suffix, last: tuple, pending: tuple) -> _State:
        key = (suffix.text, last, pending)
        found = self.states.get(key)
        if found is None:
            found = _State(suffix, last, pending, len(self.states) < self.max_states)
            if found.kept:
                self.states[key] = found
        return found

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        done, kept, suffix = state.suffix.moves.get(byte) or self._move(state.suffix, byte)
        last, pending = state.last, state.pending
        for k, token in done:
            if last[k] is None or self._fit(last[k], token):
                break
        else:
            raise AssertionError("no token fits")
        held = (*pending[k], token)
        if not kept:
            return self._state(suffix, (token,), ((),)), held
        lasts, pendings = (*[last[i] for i in kept], token), [*[pending[i] for i in kept], held]
        low, high = min(pendings), max(pendings)
        same = 0
        while same < len(low) and low[same] == high[same]:
            same += 1
        return self._state(suffix, lasts, tuple(p[same:] for p in pendings) if same else tuple(pendings)), low[:same]

    def encode(self, data: bytes) -> list[int]:
        out: list[int] = []
        state = self.start
        for byte in data:
            found = state.next.get(byte)
            if found is None:
                found = self._step(state, byte)
                if state.kept and found[0].kept:
                    state.next[byte] = found
            state, emitted = found
            if emitted:
                out += emitted
        out += state.pending[-1]
        return out


class Encoder(dict):
    """Encodes texts: every match of ``pattern`` goes through the transducer separately.

    It is also a mapping, which holds the outputs of matches seen before, as little-endian bytes; when
    it has ``max_seen`` entries it starts anew.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_seen: int = 400_000, max_states: int = 60_000):
        super().__init__()
        self.machine = MergeTransducer(ranks, max_states)
        self.find = regex.compile(pattern).findall
        self.max_seen = max_seen

    def __missing__(self, match: str) -> bytes:
        ids = np.array(self.machine.encode(match.encode()), "<u4").tobytes()
        if len(match) < 64:
            if len(self) >= self.max_seen:
                self.clear()
            self[match] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()


class StreamDecoder:
    """Decodes ids piece by piece; text comes out as soon as its characters are whole.

    The machine's state is the unfinished character: its bytes so far and how many are still
    due.  Bytes that can't be UTF-8 become U+FFFD.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.held = b""

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """The length of an unfinished character at the end, 0 to 3."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            due = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
            return back if due > back and lead < 0xF5 else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self._unfinished(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


_Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> _Step:
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = vocabulary_key(ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, lambda: shared.value, pattern)
        for batch in batches:
            found = [encoder.encode_bytes(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.large_binary()).cast(pa.binary())], names=["doc_id", "ids"])

    return run


_DECODED = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars", "text"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long"


def _decode(docs: DataFrame, ranks: dict[bytes, int], chunk: int, keep_text: bool) -> _Step:
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    names = _DECODED[: 5 + keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [b""] * (max(shared.value.values()) + 1)
        for token, i in shared.value.items():
            tokens[i] = token
        decoder = StreamDecoder(tokens)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py()
                ids = np.frombuffer(raw, "<u4")
                digest, chars, text = hashlib.sha256(), 0, []
                for at in range(0, len(ids), chunk):
                    data = decoder.bytes_of(ids[at : at + chunk].tolist())
                    digest.update(data)
                    part = decoder.feed(data)
                    chars += len(part)
                    if keep_text:
                        text.append(part)
                part = decoder.finish()
                chars += len(part)
                for column, value in zip(out, (doc_id, len(ids), hashlib.sha256(raw).hexdigest(), digest.hexdigest(), chars, "".join([*text, part])), strict=False):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _KINDS, strict=False)], names=names)

    return run


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: ids as binary, little-endian unsigned 32-bit integers.

    A null text is empty and has no ids; null ids stay null; repeated rows are encoded each
    time; other columns are ignored; an empty table gives no rows.
    """
    return _rows(docs, id_col, text_col).mapInArrow(_encode(docs, ranks, pattern), "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int], chunk: int = 4096, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars[, text]) from (doc_id, ids).

    The ids are decoded ``chunk`` at a time, so a long document needs no second copy of its
    bytes; the digest is of the decoded bytes, the text of their characters.
    """
    return encoded.mapInArrow(_decode(encoded, ranks, chunk, keep_text), _SCHEMA + ", text string" * keep_text)


def roundtrip_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chunk: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode_documents`` of ``encode_documents`` without the texts, by one worker process a task."""
    encode, decode = _encode(docs, ranks, pattern), _decode(docs, ranks, chunk, False)
    return _rows(docs, id_col, text_col).mapInArrow(lambda batches: decode(encode(batches)), _SCHEMA)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


_own: dict[str, Encoder] = {}


def vocabulary_key(ranks: dict[bytes, int], pattern: str) -> str:
    """A digest of every token, every rank and the pattern."""
    return hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()


def _encoder(key: str, ranks: Callable[[], dict[bytes, int]], pattern: str) -> Encoder:
    """One encoder a worker process and vocabulary, so that its states serve all its tasks."""
    if key not in _own:
        _own.clear()
        _own[key] = Encoder(ranks(), pattern)
    return _own[key]
