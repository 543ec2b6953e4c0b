"""Operator 2: harmonic packing.

Lengths fall into classes of reciprocal capacity: a bin of class k takes exactly k pieces. As texts may be cut freely, a
document is cut into pieces that fill their share of a bin completely, capacity/k for k = 1, 2, 4, ..., so every full bin
is gapless. Each worker numbers the pieces of each class by itself: piece i of class k goes to bin i // k, slot i % k.
Nothing is shuffled and nothing is held but the bins still open, at most k - 1 pieces a class. What is left open at a
worker's end is laid out by falling length, which again leaves no gap, and ends in sequences of a power of two.

Defined cases: a null text counts as empty and has the closing id alone; repeated rows are packed each for itself; an
empty table gives an empty table; other columns are ignored. A text of any length is cut, none is dropped.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import BoundedCache, chunks, file_bytes, texts

#: Blanks as the pre-tokenizer knows them, and what its pieces never begin in the midst of: a blank run with what follows.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
AFTER_WHITE = re.compile(f"[{WHITE}] ")
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
WHITES = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{WHITE}]", chr(c)))
#: Segments a worker remembers, the longest remembered, words encoded at a time.
CACHE_SEGMENTS, CACHE_CHARS, JOINED = 600_000, 48, 64


class ByteTokens:
    """Ids of texts by a tokenizers file, remembered by segment. The file's added tokens keep their own ids.

    A segment is a word with the blank before it, named by the word alone; a text's first word, which has no blank before
    it, is named with one. Texts with runs of white space are split into runs with what follows, named as they are after
    a line feed and a blank, which no other name begins with.
    """

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(spec)
        self.added = {str(t.content): i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cache = BoundedCache(CACHE_SEGMENTS)
        blank = self.library.encode(" a", add_special_tokens=False).tokens[0][0]
        self.opens = np.zeros(self.library.get_vocab_size(), bool)  # ids of pieces that begin with a blank
        for piece, i in self.library.get_vocab().items():
            self.opens[i] = piece.startswith(blank)

    def names(self, text: str) -> list[str]:
        if AFTER_WHITE.search(text):
            return ["\n " + x for x in SEGMENT.findall(text)]
        out = text.split(" ")
        if out[0]:
            out[0] = " " + out[0]
        else:
            del out[0]
        return out

    def _each(self, segments: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(segments, add_special_tokens=False)]

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of segments by name. Words go to the library JOINED at a time, as the blank before each keeps them apart."""
        apart = [w for w in new if not w or w[0] in WHITES or w[-1] in WHITES]
        out = dict(zip(apart, self._each([w[2:] if w.startswith("\n ") else w[1:] if w.startswith(" ") else " " + w for w in apart]), strict=True))
        words = [w for w in new if w not in out] if apart else new
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, e in zip(groups, self.library.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            begin = np.flatnonzero(self.opens[ids])
            if len(begin) == len(group) and begin[0] == 0:
                raw, at = ids.tobytes(), [*(4 * begin).tolist(), 4 * len(ids)]
                out.update(zip(group, [raw[x:y] for x, y in zip(at, at[1:], strict=False)], strict=True))
            else:
                out.update(zip(group, self._each([" " + w for w in group]), strict=True))
        return out

    def encode(self, batch: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        whole = {i for i, t in enumerate(batch) if t and any(a in t for a in self.added)}  # rare: the library takes them as they are
        split = [self.names(t) if t and i not in whole else [] for i, t in enumerate(batch)]
        known = self.cache
        new = {w for s in split for w in s if w not in known}
        if len(known) + len(new) > known.bound:
            known.clear()
            new = set().union(*split)
        if new:
            found = self.learn(list(new))
            long = [w for w in new if len(w) > CACHE_CHARS]
            known.update(found)
        out = [b"".join([known[w] for w in s]) for s in split]
        if new:
            for w in long:
                del known[w]
        for i in whole:
            out[i] = np.array(self.library.encode(batch[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out


_TOKENS: dict[str, ByteTokens] = {}


def byte_tokens(spec: bytes) -> ByteTokens:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hashlib.sha256(spec).hexdigest()
    if key not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[key] = ByteTokens(spec)
    return _TOKENS[key]


def cut(length: int, capacity: int) -> list[int]:
    """Piece lengths of a document: whole bins, then falling shares capacity/k. The capacity is a power of two."""
    rest = length % capacity
    return [capacity] * (length // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


class HarmonicBins:
    """The open bins of one worker. add() gives back the rows of a bin as soon as it is full."""

    def __init__(self, capacity: int, first_id: int):
        if capacity & (capacity - 1):
            raise ValueError("the capacity is a power of two")
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple, length: int) -> list[tuple]:
        waiting = self.open.setdefault(length, [])
        waiting.append(piece)
        if len(waiting) < self.capacity // length:
            return []
        self.open[length] = []
        self.next_id += 1
        return [(*p, self.next_id - 1, i * length) for i, p in enumerate(waiting)]

    def finish(self) -> list[tuple]:
        """Rows of what is left: by falling length, in sequences of the capacity and then of falling powers of two."""
        left = [(length, p) for length in sorted(self.open, reverse=True) for p in self.open[length]]
        out, rest, room, used = [], sum(length for length, _ in left), 0, 0
        for length, p in left:
            if used == room:
                room, used = self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1), 0
                rest -= room
                self.next_id += 1
            out.append((*p, self.next_id - 1, used))
            used += length
        self.open = {}
        return out


SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
DDL = ", ".join(f"{f.name} long" for f in SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A sequence_id is the worker's partition number above 40 bits and its own count below, so workers share nothing.
    """
    spec = docs.sparkSession.sparkContext.broadcast(file_bytes(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(spec.value)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4").tobytes()
        shares: dict[int, list[int]] = {}

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(rows, np.int64).T], schema=SCHEMA)

        for batch in batches:
            for part in chunks(batch):
                rows: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), tokens.encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    n, at = len(ids) // 4, 0
                    view = memoryview(ids)
                    for length in shares.get(n) or shares.setdefault(n, cut(n, capacity)):
                        rows += bins.add((doc, at, length, zlib.crc32(view[4 * at : 4 * (at + length)]), n), length)
                        at += length
                if rows:
                    yield table(rows)
        if rows := bins.finish():
            yield table(rows)

    return texts(docs, text_col, id_col).mapInArrow(run, DDL)
