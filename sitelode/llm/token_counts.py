"""Operator 4: word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and one for pieces that continue it. Each node
has a failure link to where matching goes on after the longest pieces that its path certainly gives, and the number of
those pieces. A word is read once, left to right; following a failure link adds that number. No piece is ever built.
A word that the vocabulary can't spell counts as one unknown token.

Defined cases: null and empty texts and texts of blanks have no words and no tokens; repeated rows give repeated rows;
an empty table gives an empty table; other columns are ignored; words of any length are read in linear time.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BoundedCache, chunks, file_bytes, texts, words

CACHE_WORDS, CACHE_BYTES = 1_000_000, 48
UNKNOWN = 1 << 40


class LongestMatch:
    """initial: pieces that begin a word; continuing: pieces that go on with one."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # node 0 begins a word, node 1 continues it
        final = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                at = root
                for c in piece:
                    nxt = self.edges[at].get(c)
                    if nxt is None:
                        nxt = self.edges[at][c] = len(self.edges)
                        self.edges.append({})
                        final.append(False)
                    at = nxt
                final[at] |= at > 1
        self.fail = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.edges[u].items():
                if final[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, extra = self.fail[u], 0
                    while z >= 0 and c not in self.edges[z]:
                        extra += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.edges[z][c], self.popped[u] + extra
                queue.append(v)
        self.cache = BoundedCache(CACHE_WORDS)

    def count(self, word: str) -> int:
        """Tokens of a word; UNKNOWN + 1 if it can't be spelled."""
        edges, fail, popped = self.edges, self.fail, self.popped
        u = n = 0
        for c in word:
            while (v := edges[u].get(c)) is None:
                if fail[u] < 0:
                    return UNKNOWN + 1
                n += popped[u]
                u = fail[u]
            u = v
        while u > 1:
            if fail[u] < 0:
                return UNKNOWN + 1
            n += popped[u]
            u = fail[u]
        return n

    def totals(self, text: str | None) -> tuple[int, int, int]:
        """(words, tokens, unknown words)."""
        split = words(text)
        cache = self.cache
        met = set(split)
        cache.room(len(met))
        known = cache
        for w in [w for w in met if w not in cache]:
            n = self.count(w.decode())
            if len(w) <= CACHE_BYTES:
                cache[w] = n
            else:
                if known is cache:
                    known = {}
                known[w] = n
        total = sum(map(cache.__getitem__, split)) if known is cache else sum(cache[w] if w not in known else known[w] for w in split)
        return len(split), total % UNKNOWN, total // UNKNOWN


def piece_vocabulary(model: bytes) -> tuple[list[str], list[str]]:
    """A piece vocabulary as a word-piece one: pieces marked as word starts begin words, the others continue them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [p[1:] for p in pieces if p.startswith("▁") and "▁" not in p[1:] and len(p) > 1], [p for p in pieces if "▁" not in p]


_AUTOMATA: dict[str, LongestMatch] = {}


def automaton(model: bytes) -> LongestMatch:
    key = hashlib.sha256(model).hexdigest()
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = LongestMatch(*piece_vocabulary(model))
    return _AUTOMATA[key]


def token_counts(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for every row."""
    model = docs.sparkSession.sparkContext.broadcast(file_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = automaton(model.value)
        for batch in batches:
            for part in chunks(batch):
                rows = [counter.totals(t) for t in part.column("text").to_pylist()]
                columns = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return texts(docs, text_col, id_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
