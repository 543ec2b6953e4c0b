"""Operator 3: reversible line dedup with sharded cuckoo filters over exact reference counts.

State is two tables. References: (shard, key, n_docs), for every line key the exact number of documents that hold it.
Filters: (shard, table), one cuckoo filter a shard, holding the fingerprints of the keys whose count has reached
the threshold. Adding documents raises counts and inserts the keys that cross the threshold; deleting documents lowers
them and deletes the keys that fall below it, so taking documents out leaves exactly the state of never having had them.

Lines are looked up in the filters only. A filter can claim a key it doesn't hold, so the exact list of false claims
among the counted keys (about one key in ten thousand) goes along: filter minus list is exact for every key the state
has counted, and no document text needs to travel.

The filters, two bytes a frequent key, go to the executors whole while their measured size is within
`broadcast_bytes`; beyond it the lines are joined to the frequent keys instead, with the same result.

Defined cases: a null or empty text is one empty line, an empty key is never dropped; a line repeated in one document
counts once; repeated rows are separate documents; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, chunks, texts
from .scratch import kept

#: Distinct keys a worker counts before it hands its counts on.
PARTIAL_KEYS = 200_000
SLOTS = 4
#: Bytes of filters that go to the executors whole, and 64 times the most false claims that go with them.
BROADCAST_BYTES = 64_000_000
REFS_DDL = "shard int, key binary, n_docs long"


def line_key(line: str) -> str:
    return ascii_lower(line.strip(BLANKS))


def digest(key: str) -> bytes:
    """128 bits stand for a key: two of 10^15 different lines share them with a chance below 10^-8."""
    return xxhash.xxh3_128_digest(key.encode())


def shard_of(key: str = "key", shards: int = 256):
    return F.pmod(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key has two buckets, each found from the other and the fingerprint.

    Keys come as rows of two unsigned 64-bit halves. Lookups are vectorised; insertions and deletions go one by one.
    """

    def __init__(self, table: np.ndarray):
        self.table = table  # (buckets, SLOTS) uint16; 0 is free

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.84)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of all keys, doubled until every key finds a place."""
        made = cls.sized(len(keys))
        while not all(made.insert(k) for k in keys):
            made = cls(np.zeros((2 * len(made.table), SLOTS), np.uint16))
        return made

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (keys[:, 1] >> np.uint64(16)) & mask
        return mark, one, self.other(one, mark)

    def other(self, bucket, mark):
        return (bucket ^ (np.asarray(mark).astype(np.uint64) * np.uint64(0x5BD1E995))) & np.uint64(len(self.table) - 1)

    def __contains__(self, key: np.ndarray) -> bool:
        return bool(self.contains(key.reshape(1, 2))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(keys)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def insert(self, key: np.ndarray) -> bool:
        mark, one, two = (x[0] for x in self.places(key.reshape(1, 2)))
        for b in (one, two):
            if len(free := np.flatnonzero(self.table[b] == 0)):
                self.table[b, free[0]] = mark
                return True
        b, turn = one, 0
        while turn < 500:
            slot = turn % SLOTS  # moves a resident on, another slot each time
            mark, self.table[b, slot] = self.table[b, slot], mark
            b = self.other(b, mark)
            if len(free := np.flatnonzero(self.table[b] == 0)):
                self.table[b, free[0]] = mark
                return True
            turn += 1
        return False  # one resident is homeless: the caller builds a larger filter from the exact table

    def delete(self, key: np.ndarray) -> bool:
        mark, one, two = (x[0] for x in self.places(key.reshape(1, 2)))
        for b in (one, two):
            if len(held := np.flatnonzero(self.table[b] == mark)):
                self.table[b, held[0]] = 0
                return True
        return False


def halves(keys: list[bytes] | np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2) if len(keys) else np.zeros((0, 2), np.uint64)


def references(docs: DataFrame, shards: int = 256, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(shard, key, n_docs): in how many documents each key occurs. Workers count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            items = list(counts.items())
            counts.clear()
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], names=["key", "n"])

        for batch in batches:
            for part in chunks(batch):
                for t in part.column("text").to_pylist():
                    for k in {digest(k) for k in set(map(line_key, t.split("\n"))) if k} if t else ():
                        counts[k] = counts.get(k, 0) + 1
                if len(counts) > PARTIAL_KEYS:
                    yield from out()
        yield from out()

    counted = texts(docs, text_col, id_col).mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n_docs"))
    return counted.select(shard_of(shards=shards).alias("shard"), "key", "n_docs")


def merge(refs: DataFrame, docs: DataFrame, sign: int, shards: int = 256) -> DataFrame:
    """References after adding (sign 1) or deleting (sign -1) documents; keys of no document go."""
    change = references(docs, shards).withColumn("n_docs", F.col("n_docs") * sign)
    return refs.unionByName(change).groupBy("shard", "key").agg(F.sum("n_docs").alias("n_docs")).where("n_docs > 0")


FILTER_DDL = "shard int, table binary"


def filters(refs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(shard, table): a cuckoo filter of each shard's frequent keys."""

    def build(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [shard[0]], "table": [CuckooFilter.of(halves(sorted(rows["key"]))).table.tobytes()]})

    return refs.where(F.col("n_docs") >= min_docs).select("shard", "key").groupBy("shard").applyInPandas(build, FILTER_DDL)


def update_filters(state: DataFrame, before: DataFrame, after: DataFrame, min_docs: int = 10) -> DataFrame:
    """Filters after counts changed: keys that crossed the threshold are inserted or deleted, nothing else is touched.

    A shard whose filter can't take an insertion is built anew from the exact counts.
    """
    b, a = before.where(F.col("n_docs") >= min_docs).select("shard", "key"), after.where(F.col("n_docs") >= min_docs).select("shard", "key")
    moved = a.join(b, ["shard", "key"], "left_anti").withColumn("sign", F.lit(1)).unionByName(b.join(a, ["shard", "key"], "left_anti").withColumn("sign", F.lit(-1)))
    everything = moved.unionByName(a.withColumn("sign", F.lit(0)))

    def step(shard: tuple, held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        s = shard[0]
        all_keys = halves(sorted(keys.loc[keys["sign"] == 0, "key"]))
        made = CuckooFilter(np.frombuffer(held["table"].iloc[0], np.uint16).reshape(-1, SLOTS).copy()) if len(held) else CuckooFilter.sized(len(all_keys))
        for k in halves(list(keys.loc[keys["sign"] == -1, "key"])):
            made.delete(k)
        if not all(made.insert(k) for k in halves(list(keys.loc[keys["sign"] == 1, "key"]))):
            made = CuckooFilter.of(all_keys)
        return pd.DataFrame({"shard": [s], "table": [made.table.tobytes()]})

    return state.groupBy("shard").cogroup(everything.groupBy("shard")).applyInPandas(step, FILTER_DDL)


def _probe(tables: dict[int, CuckooFilter], keys: np.ndarray, shards: int) -> np.ndarray:
    """Which keys the filters claim."""
    shard = (keys[:, 0] & np.uint64(0xFFFFFFFF)).astype(np.uint32).byteswap() % np.uint32(shards)
    hit = np.zeros(len(keys), bool)
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.unique(shard):
        if (made := tables.get(int(s))) is not None:
            at = order[bounds[s] : bounds[s + 1]]
            hit[at] = made.contains(keys[at])
    return hit


def _tables(rows: list) -> dict[int, CuckooFilter]:
    return {s: CuckooFilter(np.frombuffer(t, np.uint16).reshape(-1, SLOTS)) for s, t in rows}


def false_claims(refs: DataFrame, tables, min_docs: int, shards: int) -> DataFrame:
    """(key): counted keys below the threshold that a filter claims."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _tables(tables.value)
        for batch in batches:
            keys = batch.column("key")
            hit = _probe(held, halves(keys.to_pylist()), shards) if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(hit))], names=["key"])

    return refs.where(F.col("n_docs") < min_docs).select("key").mapInArrow(run, "key binary")


def _rows(drop):
    """Rows of a batch, given for each text which of its lines go."""
    n_lines, n_dropped, kept = [], [], []
    for lines, gone in drop:
        stay = [x for x, g in zip(lines, gone, strict=True) if not g] if any(gone) else lines
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(stay))
        kept.append("\n".join(stay))
    return n_lines, n_dropped, kept


SHAPES = {"text": "doc_id long, n_lines long, n_dropped long, text string", "digest": "doc_id long, n_lines long, n_dropped long, kept_sha256 string"}


def _emitter(shape: str, names: list[str], text_col: str):
    """What becomes of a batch, given for each text its lines and which of them go."""

    def emit(part: pa.RecordBatch, drops: list) -> pa.RecordBatch:
        n, d, kept_texts = _rows(drops)
        if shape == "rows":
            sizes = pa.array([len(t) for t in kept_texts], pa.int64())
            old = part.column(text_col)
            new = pa.array([t if m else o for t, m, o in zip(kept_texts, d, old.to_pylist(), strict=True)], pa.string())
            return pa.RecordBatch.from_arrays([new if c == text_col else sizes.cast(part.column(c).type) if c == "n_chars" else part.column(c) for c in names], names=names)
        last = kept_texts if shape == "text" else [hashlib.sha256(t.encode()).hexdigest() for t in kept_texts]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(last, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text" if shape == "text" else "kept_sha256"])

    return emit


def dedup(docs: DataFrame, refs: DataFrame, min_docs: int = 10, shards: int = 256, broadcast_bytes: int = BROADCAST_BYTES, text_col: str = "text", id_col: str = "doc_id", shape: str = "text") -> DataFrame:
    """Documents without the lines that are frequent by the reference counts of a corpus.

    shape: "text" gives (doc_id, n_lines, n_dropped, text), "digest" kept_sha256 in place of the text, "rows" the rows and
    columns of docs with the text, and n_chars where there is one, brought up to date.
    refs should be a written table: it is read three times.
    """
    spark = docs.sparkSession
    frequent = refs.where(F.col("n_docs") >= min_docs)
    if shape == "rows":
        table, at = docs, text_col
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    else:
        table, at, ddl = texts(docs, text_col, id_col), "text", SHAPES[shape]
    emit = _emitter(shape, docs.columns, at)
    bytes_needed = 4 * frequent.count() + 64 * shards  # two bytes a slot, at worst half filled
    if bytes_needed > broadcast_bytes:
        return _joined(table, at, frequent.select("key"), ddl, emit)
    sent = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in filters(refs, min_docs).select("shard", "table").collect()])
    listed = [bytes(r[0]) for r in false_claims(refs, sent, min_docs, shards).limit(broadcast_bytes // 64 + 1).collect()]
    if len(listed) > broadcast_bytes // 64:
        return _joined(table, at, frequent.select("key"), ddl, emit)
    exceptions = spark.sparkContext.broadcast(frozenset(listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, never = _tables(sent.value), exceptions.value
        for batch in batches:
            for part in chunks(batch):
                split = [(t or "").split("\n") for t in part.column(at).to_pylist()]
                names = [line_key(x) for lines in split for x in lines]
                ids = list(map(digest, names))
                claimed = _probe(held, halves(ids), shards)
                gone = [bool(c) and bool(k) and i not in never for c, k, i in zip(claimed.tolist(), names, ids, strict=True)]
                drops, n = [], 0
                for lines in split:
                    drops.append((lines, gone[n : n + len(lines)]))
                    n += len(lines)
                yield emit(part, drops)

    return table.mapInArrow(run, ddl)


def _joined(table: DataFrame, at: str, frequent: DataFrame, ddl: str, emit) -> DataFrame:
    """The same without anything broadcast: each row's distinct keys meet the frequent keys, and go back to the row."""
    row, hit, found = (_free(n, table.columns) for n in ("row", "hit", "keys"))
    numbered = kept(table.withColumn(row, F.monotonically_increasing_id()))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                pairs = [(r, digest(k)) for r, t in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True) for k in sorted(set(map(line_key, (t or "").split("\n")))) if k]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in pairs], pa.int64()), pa.array([k for _, k in pairs], pa.binary())], names=["row", "key"])

    hits = numbered.select(F.col(row).alias("row"), F.col(at).alias("text")).mapInArrow(keys, "row long, key binary")
    hits = hits.join(frequent.hint("merge"), "key").groupBy(F.col("row").alias(hit)).agg(F.collect_list("key").alias(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                drops = []
                for t, ks in zip(part.column(at).to_pylist(), part.column(found).to_pylist(), strict=True):
                    lines, hot = (t or "").split("\n"), set(ks or ())
                    drops.append((lines, [bool(k := line_key(x)) and digest(k) in hot for x in lines] if hot else [False] * len(lines)))
                yield emit(part, drops)

    return numbered.join(hits, F.col(row) == F.col(hit), "left").drop(hit, row).mapInArrow(run, ddl)


def _free(name: str, columns: list[str]) -> str:
    """A column name that isn't taken."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def dedup_corpus(docs: DataFrame, min_docs: int = 10, shards: int = 256, shape: str = "text", broadcast_bytes: int = BROADCAST_BYTES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """dedup() of a table against its own counts. The counts are written to the checkpoint folder once."""
    return dedup(docs, kept(references(docs, shards, text_col, id_col)), min_docs, shards, broadcast_bytes, text_col, id_col, shape)
