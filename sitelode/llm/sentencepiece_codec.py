"""Operator 1: SentencePiece encoding and decoding for merge-type vocabularies.

Encoding follows the score-ordered agenda: every adjacent pair of symbols whose concatenation is a piece waits in a
heap, best score first and leftmost among equals; popping a pair that still stands merges it and queues the two pairs
it now forms. No piece of the vocabulary crosses from a letter into a blank, so a text falls apart into independent
segments (a run of blanks with what follows it), and a worker keeps the ids of segments it has met in a bounded cache.
Each segment's ids are checked, per Arrow batch, against the sentencepiece library when it is first met; where they
differ the library's count. Decoding is the library's. A vocabulary with pieces that cross a blank has no such segments: its texts are single ones.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows give repeated rows; an
empty table gives an empty table; other columns of the input are ignored. A segment of any length costs n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BoundedCache, chunks, file_bytes, texts

SPACE = "▁"
SEGMENT = re.compile(" *[^ ]+| +")
#: Segments a worker remembers, and the longest remembered.
CACHE_SEGMENTS, CACHE_CHARS = 600_000, 48


class AgendaEncoder:
    """The vocabulary of one model file, and its encoder."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks: dict[str, tuple[float, int]] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.ranks[sp.id_to_piece(i)] = (-sp.get_score(i), i)
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.ranks)
        self.differed = 0
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_ids = byte_ids if all(sp.is_byte(i) for i in byte_ids) else None
        self.unknown = sp.unk_id()
        self.cache: BoundedCache = BoundedCache(CACHE_SEGMENTS)

    def merge(self, symbols: str) -> list[int]:
        """Ids of one segment, its blanks already written as the vocabulary writes them."""
        ranks = self.ranks
        parts: list[str | None] = list(symbols)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = parts[i] + parts[i + 1]
            if (r := ranks.get(pair)) is not None:
                agenda.append((r[0], i, pair))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, pair = pop(agenda)
            if parts[i] is None or (j := right[i]) >= n or parts[i] + parts[j] != pair:
                continue  # one side has been merged away since
            parts[i], parts[j] = pair, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(joined := pair + parts[k])) is not None:
                    push(agenda, (r[0], i, joined))
            if (h := left[i]) >= 0 and (r := ranks.get(joined := parts[h] + pair)) is not None:
                push(agenda, (r[0], h, joined))
        ids: list[int] = []
        for p in parts:
            if p is None:
                continue
            if (r := ranks.get(p)) is not None:
                ids.append(r[1])
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in p.encode())
            else:
                ids.append(self.unknown)
        return ids

    def learn(self, segments: list[str]) -> dict[str, bytes]:
        """Segments (starting with a blank each) to little-endian ids, checked against the library."""
        own = [self.merge(s.replace(" ", SPACE)) for s in segments]
        theirs = self.library.encode([s[1:] for s in segments], num_threads=1)  # the library puts the first blank itself
        for i, (s, a, b) in enumerate(zip(segments, own, theirs, strict=True)):
            if a != b and s != " ":  # the library has no ids for the empty text
                self.differed += 1
                own[i] = b
        return {s: np.array(i, "<i4").tobytes() for s, i in zip(segments, own, strict=True)}

    def encode(self, batch: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text."""
        split = []
        for t in batch:
            if not t:
                split.append([])
                continue
            if SPACE in t:
                t = t.replace(SPACE, " ")
            if self.crossing:
                split.append([" " + t])
                continue
            parts = t.split(" ")
            if "" in parts:
                split.append(SEGMENT.findall(" " + t))
            else:
                split.append([" " + p for p in parts])
        known = self.cache
        new = {s for parts in split for s in parts if s not in known}
        if len(known) + len(new) > known.bound:
            known.clear()
            new = set().union(*split)
        known.update(self.learn(list(new)) if new else {})
        out = [b"".join([known[s] for s in parts]) for parts in split]
        for s in new:
            if len(s) > CACHE_CHARS:
                del known[s]
        return out


_ENCODERS: dict[str, AgendaEncoder] = {}


def encoder(model: bytes) -> AgendaEncoder:
    """One per worker and model: reused from task to task."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = AgendaEncoder(model)
    return _ENCODERS[key]


def _mapper(model, row, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for batch in batches:
            for part in chunks(batch):
                rows = row(enc, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(rows, schema.types[1:], strict=True))], schema=schema)

    return run


def encode(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every row; the text the ids decode to comes along."""
    model = docs.sparkSession.sparkContext.broadcast(file_bytes(model_path))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def row(enc, batch):
        ids = [np.frombuffer(b, "<i4").tolist() for b in enc.encode(batch)]
        return ids, enc.library.decode(ids, num_threads=1) if ids else []

    return texts(docs, text_col, id_col).mapInArrow(_mapper(model, row, schema), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() reduced to digests before it leaves the worker."""
    model = docs.sparkSession.sparkContext.broadcast(file_bytes(model_path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def row(enc, batch):
        ids = [np.frombuffer(b, "<i4").tolist() for b in enc.encode(batch)]
        decoded = enc.library.decode(ids, num_threads=1) if ids else []
        return [len(i) for i in ids], [hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in ids], [hashlib.sha256(t.encode()).hexdigest() for t in decoded]

    return texts(docs, text_col, id_col).mapInArrow(_mapper(model, row, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(ids: DataFrame, model_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text): the library's decode of each row's ids; null ids count as none."""
    model = ids.sparkSession.sparkContext.broadcast(file_bytes(model_path))

    def run(batches):
        sp = encoder(model.value).library
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([sp.decode(i or []) or "" for i in part.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return ids.select(ids[id_col].cast("long").alias("doc_id"), ids[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
