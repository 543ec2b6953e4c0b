"""Operator 9: n-gram Jaccard join by T-occurrence search.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Equal sets are one class, named by a 64-bit
digest of the set; all that follows works on classes, and copies are never paired.

1.  Frequent shingles. Workers count their shingles in blocks and ship those that a block has twice or more (lossy
    counting: none is missed that has HOT_LEAST documents beyond one a block). At most HOT_LIMIT of them, the most
    frequent, go to every worker, so that no list of a common passage is ever gathered under one key.
2.  Frequencies. The shingles of each class meet by hash range, in groups of about GROUP_SHINGLES; those of two classes or
    more go back to their classes. A class that shares less than T = ceil(0.75 n) of its n shingles with others links with
    nothing, and leaves. The rest list their shared shingles rarest first: this order is the same for all.
3.  Short lists. Two sets of n and m shingles that link share T at least, so the first n - T + k of each set's order share
    min(k) with the other's. Those prefixes, inverted, are the lists.
4.  Groups. In every list each set is paired with the least one. Pairs that share enough are verified, and linked sets
    become one component: a group of near copies costs about a pair a member, as rarest-first lists repeat their members.
5.  The rest. Components that meet in a list form clusters. Within a cluster, sets are dealt into blocks of BLOCK by size
    band; blocks of the same band and of neighbouring bands meet, each set searches the other block's lists, and pairs of
    different components that share what they must are verified there. No pair that could link is left untested.

The search of 4 and 5 is T-occurrence search: the set's shingles pick the inverted lists of the block, the longest of which
are put aside; the short ones are heap-merged, whatever occurs T - L times or more is looked up in the L long ones by binary
search (DivideSkip), and what reaches its required overlap is a candidate (5) or is linked (verification).

Defined cases: null and empty texts and texts of blanks have an empty set, link with nothing and are their own
component; a text of one to four words is one shingle; repeated rows are copies; rows of one id with different texts are
different sets under one id; rows with a null id count as documents, and their component is null where no row linked with them has an id;
an empty table gives an empty table; other columns are ignored. Every text counts whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, chunks, texts
from .components import components
from .scratch import kept

WORDS, NUM, DEN = 5, 75, 100
#: Share of a set's size that k adds to the prefix, most frequent shingles, least documents of one, sets in a block.
EXTRA, HOT_LIMIT, HOT_LEAST, BLOCK = 0.08, 1_000_000, 24, 256
#: Shingles a worker holds before it hands its blocks on, shingles of a group, sets or pairs a group of later steps has.
HELD, GROUP_SHINGLES, GROUP_ROWS = 2_000_000, 1_000_000, 512
#: Rows up to which a table of ids (16 bytes each) is broadcast; beyond, it is joined.
BROADCAST_ROWS = 1_000_000
HOT = np.uint32(1 << 31)
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class Shingler:
    def __init__(self):
        self.cache = BoundedCache(200_000)

    def __call__(self, batch: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct 64-bit hashes of each text; the windows of all texts are hashed in one go."""
        splits = [t.encode().lower().split() if t else [] for t in batch]
        flat = list(chain.from_iterable(splits))
        cache = self.cache
        met = set(flat)
        cache.room(len(met))
        for w in met:
            if w not in cache:
                cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, flat), np.uint64, len(flat))
        n = max(0, len(h) - WORDS + 1)
        mixed = np.zeros(n, np.uint64)
        for i in range(WORDS):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * MULTIPLIERS[(i + 1) % WORDS] + h[i : i + n] * MULTIPLIERS[i]
        mixed ^= mixed >> np.uint64(32)
        mixed *= MULTIPLIERS[0]
        mixed ^= mixed >> np.uint64(29)
        out, at = [], 0
        for split in splits:
            if len(split) >= WORDS:
                own = np.sort(mixed[at : at + len(split) - WORDS + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            else:
                out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(split), 1)] if split else [], np.uint64))
            at += len(split)
        return out


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def least_overlap(n):
    """Shingles a set of n must share to link with anything."""
    return -(-NUM * n // DEN)


def required(n, m):
    """Shared shingles at which sets of n and m link: 100 i >= 75 (n + m - i)."""
    return -(-NUM * (n + m) // (DEN + NUM))


def extra(n):
    return 1 + (n * int(100 * EXTRA)) // 100


def least_shared(n, m):
    """Prefix shingles that two sets of n and m share at least if they link. All they share up to the earlier end of the two
    prefixes is in both; beyond it they share at most what that set has left, T - k."""
    left = np.maximum(np.maximum(0, least_overlap(n) - extra(n)), np.maximum(0, least_overlap(m) - extra(m)))
    return np.maximum(np.minimum(extra(n), extra(m)), required(n, m) - left)


def _ends(group: np.ndarray, groups: int) -> np.ndarray:
    """Where each group begins among sorted group numbers."""
    return np.searchsorted(group, np.arange(groups + 1))


def _group(tokens: np.ndarray, groups: int) -> np.ndarray:
    """Group numbers of hashes by range."""
    return (((tokens >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _scan(docs: DataFrame, make, ddl: str) -> DataFrame:
    """make() gives take(batch, sets) -> batches and a function for what is left at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        take, end = make()
        for batch in batches:
            for part in chunks(batch):
                yield from take(part, shingles(part.column("text").to_pylist()))
        yield from end()

    return docs.mapInArrow(run, ddl)


BLOCKS = pa.schema([("group", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
BLOCKS_DDL = "group int, kind int, a binary, b binary, c binary, d binary"


def _blocks(kind: int, group: np.ndarray, groups: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of `columns`, packed by group number, a batch in about a hundred groups."""
    order = np.argsort(group, kind="stable")
    columns = [c[order] for c in columns]
    at = _ends(group[order], groups)
    rows = [(b, kind, *(c[at[b] : at[b + 1]].tobytes() for c in columns), *[None] * (4 - len(columns))) for b in range(groups) if at[b] < at[b + 1]]
    for i in range(0, len(rows), 100):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + 100], strict=True), BLOCKS, strict=True)], schema=BLOCKS)


def hot_shingles(docs: DataFrame, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """High halves of the hashes of the most frequent shingles, sorted, and their counts; at most HOT_LIMIT. Only the order in
    which sets list their shingles and the way they travel depend on them, never a result."""

    def make():
        held: list[np.ndarray] = []
        seen = BoundedCache(300_000)

        def out():
            if held:
                keys, n = np.unique(np.concatenate(held).astype(np.uint32), return_counts=True)
                held.clear()
                keys, n = keys[n > 1], n[n > 1]
                yield from _blocks(0, _group(keys.astype(np.uint64) << np.uint64(32), groups), groups, keys, n.astype(np.uint32))

        def take(part, sets):
            for s in sets:
                if len(s) and (c := class_of(s)) not in seen:
                    seen.room(1)
                    seen[c] = True
                    held.append(s >> np.uint64(32))
            if sum(map(len, held)) > HELD:
                yield from out()

        return take, out

    def add(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["a"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["b"].to_pylist()])
        each, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, n).astype(np.int64)
        often = total >= HOT_LEAST
        return pa.table({"key": each[often].astype(np.int64), "n": total[often]})

    counted = kept(_scan(docs, make, BLOCKS_DDL).groupBy("group").applyInArrow(add, "key long, n long"))
    at_least, total = HOT_LEAST, 0
    for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect():
        total += r["count"]
        if total > HOT_LIMIT:
            at_least = 2 ** (r["power"] + 1)
            break
    table = counted.where(F.col("n") >= at_least).limit(HOT_LIMIT).toArrow()
    keys = table["key"].to_numpy().astype(np.uint32)
    order = np.argsort(keys)
    return keys[order], np.minimum(table["n"].to_numpy()[order], HOT - 1).astype(np.uint32)


def sets_of(docs: DataFrame) -> DataFrame:
    """A written table of two kinds of rows: kind 0 has (doc_id, n, class) of every document, n = 0 where the set is empty;
    kind 1 has (class, n, listed, tokens) of every class that could link: its shared shingles, rarest first, `listed` of
    which are its prefix."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // (5 * GROUP_SHINGLES)))
    sent = spark.sparkContext.broadcast(hot_shingles(docs, groups))

    def make():
        held: list[np.ndarray] = []
        ids: list[int] = []
        seen = BoundedCache(300_000)
        hot, often = sent.value

        def out():
            if not held:
                return
            sizes = np.array([len(x) for x in held], np.int64)
            tokens, who = np.concatenate(held), np.array(ids, np.int64)
            owner = np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)
            held.clear(), ids.clear()
            home = _group(who.view(np.uint64), groups)
            yield from _blocks(2, home, groups, who, sizes.astype(np.uint32))
            if len(hot):
                high = (tokens >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(hot, high), len(hot) - 1)
                is_hot = hot[at] == high
                del high
                mine = owner[is_hot]
                yield from _blocks(1, home[mine], groups, tokens[is_hot], who[mine], often[at[is_hot]] | HOT)
                tokens, owner = tokens[~is_hot], owner[~is_hot]
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            at = _ends(_group(tokens, groups), groups)
            for b in range(groups):
                x, y = tokens[at[b] : at[b + 1]], owner[at[b] : at[b + 1]]
                if len(x):
                    used, local = np.unique(y, return_inverse=True)
                    local = local.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
                    row = (b, 3, x.astype(np.uint32).tobytes(), (x >> np.uint64(32)).astype(np.uint16).tobytes(), local.tobytes(), who[used].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCKS, strict=True)], schema=BLOCKS)

        def take(part, sets):
            docs_, names = part.column("doc_id").to_pylist(), [class_of(s) if len(s) else 0 for s in sets]
            n = np.array([len(s) for s in sets], np.uint32)
            at = int(xxhash.xxh3_64_intdigest(str(docs_[0]).encode())) % groups
            row = (at, 0, np.array([0 if d is None else d for d in docs_], np.int64).tobytes(), np.array(names, np.int64).tobytes(), n.tobytes(), np.array([d is None for d in docs_]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCKS, strict=True)], schema=BLOCKS)
            for c, s in zip(names, sets, strict=True):
                if len(s) and c not in seen:
                    seen.room(1)
                    seen[c] = True
                    held.append(s)
                    ids.append(c)
            if sum(map(len, held)) > HELD:
                yield from out()

        return take, out

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Raw shingles of one group to those of two classes or more, with their frequency; the other kinds pass."""
        tokens, owner = [], []
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            yield batch.filter(pa.array(kinds != 3))
            raw = batch.filter(pa.array(kinds == 3))
            for group, low, mid, local, who in zip(*(raw.column(c).to_pylist() for c in ("group", "a", "b", "c", "d")), strict=True):
                low = np.frombuffer(low, np.uint32)
                tokens.append(low | np.frombuffer(mid, np.uint16).astype(np.uint64) << np.uint64(32))
                owner.append(np.frombuffer(who, np.int64)[np.frombuffer(local, np.uint16 if len(local) == 2 * len(low) else np.uint32)])
        if not tokens:
            return
        tokens, owner = np.concatenate(tokens), np.concatenate(owner)
        order = np.argsort(tokens)  # only what another has too is worth sorting by class
        tokens, owner = tokens[order], owner[order]
        twin = np.zeros(len(tokens), bool)
        twin[1:] = tokens[1:] == tokens[:-1]
        twin[:-1] |= twin[1:]
        tokens, owner = tokens[twin], owner[twin]
        order = np.lexsort((owner, tokens))
        at = order[_runs(tokens[order], owner[order])] if len(order) else order  # a class that several workers met counts once
        tokens, owner = tokens[at], owner[at]
        begin = _runs(tokens) if len(tokens) else np.zeros(0, np.int64)
        often = np.repeat(*[np.diff(np.append(begin, len(tokens)))] * 2)
        tokens, owner, often = tokens[often > 1], owner[often > 1], often[often > 1]
        if len(tokens):
            full = tokens | np.uint64(group % (1 << 16)) << np.uint64(48)
            yield from _blocks(1, _group(owner.view(np.uint64), groups), groups, full, owner, often.astype(np.uint32))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents as they came; classes with what they share, in order."""
        rows = pa.Table.from_batches(batches, BLOCKS)
        kinds = rows["kind"].to_numpy()
        cells = [rows[c].to_pylist() for c in "abcd"]
        read = lambda kind, *types: [np.concatenate([np.frombuffer(cells[j][i], t) for i in np.flatnonzero(kinds == kind)] or [np.zeros(0, t)]) for j, t in enumerate(types)]
        doc, name, n, null = read(0, np.int64, np.int64, np.uint32, bool)
        if len(doc):
            empty = pa.nulls(len(doc))
            yield _row(0, pa.array(doc, pa.int64(), mask=null), n, pa.array(name, pa.int64(), mask=n == 0), empty.cast(pa.int32()), empty.cast(pa.binary()))
        who, size = read(2, np.int64, np.uint32)
        who, at = np.unique(who, return_index=True)
        size = size[at].astype(np.int64)
        tokens, owner, often = read(1, np.uint64, np.int64, np.uint32)
        if not len(tokens):
            return
        order = np.lexsort((tokens, often, owner))
        order = order[_runs(owner[order], tokens[order])]
        tokens, owner = tokens[order], owner[order]
        begin = _runs(owner)
        end = np.append(begin[1:], len(owner))
        n = size[np.searchsorted(who, owner[begin])]
        live = end - begin >= least_overlap(n)
        begin, end, n = begin[live], end[live], n[live]
        listed = np.minimum(n, n - least_overlap(n) + extra(n)) - (n - (end - begin))
        for i in range(0, len(begin), 1000):
            j = slice(i, i + 1000)
            held = [tokens[x:y].tobytes() for x, y in zip(begin[j], end[j], strict=True)]
            yield _row(1, pa.nulls(len(held)).cast(pa.int64()), n[j], pa.array(owner[begin[j]], pa.int64()), pa.array(listed[j], pa.int32()), pa.array(held, pa.binary()))

    def _row(kind, doc, n, name, listed, tokens):
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.int32()), doc, pa.array(n, pa.int64()), name, listed, tokens], names=["kind", "doc_id", "n", "class", "listed", "tokens"])

    met = _scan(docs, make, BLOCKS_DDL).groupBy("group").applyInArrow(meet, BLOCKS_DDL)
    return kept(met.groupBy("group").applyInArrow(gather, "kind int, doc_id long, n long, class long, listed int, tokens binary"))


def divide_skip(lists: list[np.ndarray], threshold: int) -> dict[int, int]:
    """Ids that at least `threshold` of the sorted lists hold, with the number of lists."""
    if len(lists) < threshold:
        return {}
    lists = sorted(lists, key=len, reverse=True)
    longest = len(lists[0]) if lists else 0
    aside = min(len(lists), int(threshold / (0.0085 * math.log2(longest + 1) + 1))) if longest > 1 else 0
    aside = min(aside, threshold - 1)  # something must occur in the short lists
    long, short = lists[:aside], lists[aside:]
    need, found = threshold - aside, {}
    last, n = None, 0
    for i in heapq.merge(*(x.tolist() for x in short)):
        if i == last:
            n += 1
            continue
        if n >= need:
            found[last] = n
        last, n = i, 1
    if n >= need:
        found[last] = n
    if not long or not found:
        return {i: n for i, n in found.items() if n >= threshold}
    ids = np.array(list(found), np.int64)
    total = np.array(list(found.values()), np.int64)
    for x in long:
        at = np.minimum(np.searchsorted(x, ids), len(x) - 1)
        total += x[at] == ids
    return {int(i): int(t) for i, t in zip(ids, total, strict=True) if t >= threshold}


class Lists:
    """The inverted lists of a block of sets."""

    def __init__(self, sets: list[np.ndarray]):
        joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(joined, kind="stable")
        joined, self.owner = joined[order], owner[order]
        self.begin = _runs(joined) if len(joined) else np.zeros(0, np.int64)
        self.tokens, self.end = joined[self.begin], np.append(self.begin[1:], len(joined))

    def search(self, query: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Sets of the block that share with the query what each needs."""
        if not len(self.tokens) or not len(need):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        found = divide_skip([self.owner[self.begin[i] : self.end[i]] for i in at], int(need.min()))
        return np.array([i for i, shared in found.items() if shared >= need[i]], np.int64)


NEVER = 1 << 40


def search(query: np.ndarray, n: int, candidates: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Which candidates link with the query, all given by what they share with any other set, and their whole sizes."""
    return Lists(candidates).search(query, required(n, sizes))


def stars(sets: DataFrame) -> DataFrame:
    """(a, b): every class of a list with the least of it, b, where they share a quarter of what they must."""
    spark = sets.sparkSession
    listed = sets.agg(F.sum("listed")).first()[0] or 0
    groups = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-listed // GROUP_SHINGLES))

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                each = [np.frombuffer(t, np.uint64)[:k] for t, k in zip(part.column("tokens").to_pylist(), part.column("listed").to_pylist(), strict=True)]
                size = [len(t) for t in each]
                tokens = np.concatenate(each)
                # a hash's high bits name the group it was counted in, so it is mixed before it is dealt
                yield from _blocks(0, _group(tokens * MULTIPLIERS[0], groups), groups, tokens, np.repeat(part.column("class").to_numpy(), size), np.repeat(part.column("n").to_numpy(), size))

    def pair(rows: pa.Table) -> pa.Table:
        tokens, name, n = (np.concatenate([np.frombuffer(x, t) for x in rows[c].to_pylist()]) for c, t in (("a", np.uint64), ("b", np.int64), ("c", np.int64)))
        order = np.lexsort((name, tokens))
        tokens, name, n = tokens[order], name[order], n[order]
        begin = _runs(tokens)
        first = np.repeat(begin, np.diff(np.append(begin, len(tokens))))
        use = np.flatnonzero((np.arange(len(tokens)) != first) & (n * NUM <= n[first] * DEN) & (n[first] * NUM <= n * DEN))
        a, b, k = name[use], name[first[use]], np.minimum(extra(n[use]), extra(n[first[use]]))
        order = np.lexsort((b, a))
        a, b, k = a[order], b[order], k[order]
        at = _runs(a, b) if len(a) else np.zeros(0, np.int64)
        return pa.table({"a": a[at], "b": b[at], "k": k[at], "shared": np.diff(np.append(at, len(a)))})

    pairs = sets.select("class", "n", "listed", "tokens").mapInArrow(invert, BLOCKS_DDL).groupBy("group").applyInArrow(pair, "a long, b long, k long, shared long")
    return kept(pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("k").alias("k")).where("4 * shared >= k").select("a", "b"))


def _dealt(rows: DataFrame, n_rows: int, per_group: int, *keys: str) -> DataFrame:
    """Rows with a group number: many small keys a group, and a few more groups than tasks."""
    groups = max(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // per_group))
    return rows.withColumn("group", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int"))


def _each(rows: pa.Table, *keys: str) -> Iterator[pa.Table]:
    """The rows of every key."""
    rows = rows.sort_by([(k, "ascending") for k in keys])
    at = [*_runs(*(rows[k].to_numpy() for k in keys)), rows.num_rows]
    for x, y in zip(at, at[1:], strict=False):
        yield rows.slice(x, y - x)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes that link.

    A class's shingles travel once for each set they are compared with: candidates of one set b come in blocks of about
    BLOCK, the set itself joins every block, and no block depends on how many candidates there are.
    """
    pairs = pairs.select("a", "b")
    sized = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = pairs.join(_small(sized), "b").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    wanted = kept(placed.select(F.col("a").alias("class"), "b", "block").unionByName(placed.select(F.col("b").alias("class"), "b", "block").distinct()))
    n_wanted = wanted.count()
    have = sets.select("class", "n", "tokens")
    rows = have.join(F.broadcast(wanted) if n_wanted <= BROADCAST_ROWS else wanted, "class")

    def test(rows: pa.Table) -> pa.Table:
        a, b = [], []
        for one in _each(rows, "b", "block"):
            name, n = one["class"].to_numpy(), one["n"].to_numpy()
            held = [np.frombuffer(x, np.uint64) for x in one["tokens"].to_pylist()]
            query = one["b"][0].as_py()
            at = int(np.flatnonzero(name == query)[0])
            rest = [i for i in range(len(held)) if i != at]
            linked = search(held[at], int(n[at]), [held[i] for i in rest], n[rest]) if rest else []
            a += [int(name[rest[i]]) for i in linked]
            b += [query] * len(linked)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _dealt(rows, n_wanted, GROUP_ROWS, "b", "block").groupBy("group").applyInArrow(test, "a long, b long")


def _mixed(named: DataFrame) -> DataFrame:
    """(u, v): components that meet in a list, each with the least one there."""
    spark = named.sparkSession
    listed = named.agg(F.sum("listed")).first()[0] or 0
    groups = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-listed // GROUP_SHINGLES))

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                each = [np.frombuffer(t, np.uint64)[:k] for t, k in zip(part.column("tokens").to_pylist(), part.column("listed").to_pylist(), strict=True)]
                tokens, name = np.concatenate(each), np.repeat(part.column("component").to_numpy(), [len(t) for t in each])
                order = np.lexsort((name, tokens))
                order = order[_runs(tokens[order], name[order])]  # members of one component count once
                yield from _blocks(0, _group(tokens[order] * MULTIPLIERS[0], groups), groups, tokens[order], name[order])

    def meet(rows: pa.Table) -> pa.Table:
        tokens, name = (np.concatenate([np.frombuffer(x, t) for x in rows[c].to_pylist()]) for c, t in (("a", np.uint64), ("b", np.int64)))
        order = np.lexsort((name, tokens))
        order = order[_runs(tokens[order], name[order])]
        tokens, name = tokens[order], name[order]
        begin = _runs(tokens)
        first = np.repeat(begin, np.diff(np.append(begin, len(tokens))))
        use = np.arange(len(tokens)) != first
        edges = np.unique(np.stack([name[use], name[first[use]]], 1), axis=0)
        return pa.table({"u": edges[:, 0], "v": edges[:, 1]})

    return named.select("component", "listed", "tokens").mapInArrow(invert, BLOCKS_DDL).groupBy("group").applyInArrow(meet, "u long, v long").distinct()


def rest(named: DataFrame) -> DataFrame:
    """(a, b): links between components, at least one for any two that have links. named: sets with their component.

    What a set's search finds is verified on the spot, and of its links with one component in one block one is given."""
    edges = kept(_mixed(named))
    clusters = components(edges, "u", "v").select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    inside = kept(named.join(_small(clusters), "component").select("class", "n", "listed", "tokens", "component", "cluster", F.floor(F.log("n") / math.log(DEN / NUM)).cast("int").alias("band")))
    # sets that link are at most one band apart, as their sizes differ by DEN / NUM at most
    bands = kept(inside.groupBy("cluster", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    near = bands.select("cluster", "band", F.col("blocks").alias("own"))
    for name, step in (("lower", 1), ("upper", -1)):
        near = near.join(bands.select("cluster", (F.col("band") + step).alias("band"), F.col("blocks").alias(name)), ["cluster", "band"], "left")
    near = near.na.fill(0)
    placed = inside.join(_small(near), ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("own")).cast("int"))
    meeting = lambda low, lower, high, upper, side: F.struct(low.alias("low"), lower.alias("lower_block"), high.alias("high"), upper.alias("upper_block"), F.lit(side).alias("side"))
    band, block = F.col("band"), F.col("block")
    to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.concat(
        F.transform(F.sequence(block, F.col("own") - 1), lambda j: meeting(band, block, band, j, 0)),
        F.transform(F.sequence(F.lit(0), block), lambda j: F.when(j < block, meeting(band, j, band, block, 1))),
        F.transform(to(F.col("lower")), lambda j: meeting(band - 1, j, band, block, 1)),
        F.transform(to(F.col("upper")), lambda j: meeting(band, block, band + 1, j, 0)),
    )
    rows = placed.select("class", "n", "component", "listed", "tokens", "cluster", F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("p")).select("class", "n", "component", "listed", "tokens", "cluster", "p.*")
    key = ("cluster", "low", "lower_block", "high", "upper_block")
    n_rows = placed.agg(F.sum(F.col("own") + F.col("lower") + F.col("upper"))).first()[0] or 0

    def find(rows: pa.Table) -> pa.Table:
        a, b = [], []
        for one in _each(rows, *key):
            name, n, comp, side = (one[c].to_numpy() for c in ("class", "n", "component", "side"))
            if (comp == comp[0]).all():
                continue
            whole = [np.frombuffer(x, np.uint64) for x in one["tokens"].to_pylist()]
            held = [x[:k] for x, k in zip(whole, one["listed"].to_pylist(), strict=True)]
            same = one["low"][0].as_py() == one["high"][0].as_py() and one["lower_block"][0].as_py() == one["upper_block"][0].as_py()
            queries, block = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
            # the largest component of the block has lists of its own, which its own members needn't search
            each, times = np.unique(comp[block], return_counts=True)
            largest = each[times.argmax()] if len(each) else None
            parts = [p for p in (block[comp[block] == largest], block[comp[block] != largest]) if len(p)]
            for part in parts:
                lists = Lists([held[i] for i in part])
                for q in queries:
                    if (comp[part] == comp[q]).all():
                        continue
                    fits = (comp[part] != comp[q]) & (n[part] * NUM <= n[q] * DEN) & (n[q] * NUM <= n[part] * DEN)
                    if same:
                        fits &= part > q
                    if fits.any():
                        hit = part[lists.search(held[q], np.where(fits, least_shared(n[q], n[part]), NEVER))]
                        linked = hit[search(whole[q], int(n[q]), [whole[i] for i in hit], n[hit])] if len(hit) else hit
                        one_each = linked[np.unique(comp[linked], return_index=True)[1]]
                        a += [int(name[q])] * len(one_each)
                        b += name[one_each].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return kept(_dealt(rows, n_rows, 2 * BLOCK, *key).groupBy("group").applyInArrow(find, "a long, b long"))


def join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, class, component_id) for every row."""
    both = sets_of(texts(docs, text_col, id_col))
    rows = both.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "class")
    sets = both.where("kind = 1").select("class", "n", "listed", "tokens")
    links = kept(verified(stars(sets), sets))
    groups = components(links)
    named = sets.join(_small(groups), sets["class"] == groups["node"], "left").select("class", "n", "listed", "tokens", F.coalesce("component", "class").alias("component"))
    more = rest(kept(named))
    if more.limit(1).count():
        groups = components(links.unionByName(more))

    # classes get their least id before the rows join, so that no component is a shuffle key of rows
    first = kept(rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    linked = kept(first.join(_small(groups), first["class"] == groups["node"]).select("class", "component", "first"))
    least = kept(linked.groupBy("component").agg(F.min("first").alias("component_id")))
    of_class = linked.join(_small(least), "component").select("class", "component_id")
    known = kept(first.join(_small(of_class), "class", "left").where("copies > 1 or component_id is not null").select("class", F.coalesce("component_id", "first").alias("component_id")))
    return rows.join(_small(known), "class", "left").select("doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"))


def _small(ids: DataFrame) -> DataFrame:
    """Marked for broadcast where it has BROADCAST_ROWS rows at most; beyond, the join shuffles."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns as they are, without those that link, directly or over others, to a smaller id. Of rows
    that repeat an id and its set, one stays."""
    told = kept(join(docs, text_col, id_col))
    gone = kept(told.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct())
    gone = _small(gone)
    left = docs.join(gone, docs[id_col].cast("long") == gone["gone"], "left_anti")
    twice = kept(told.where("doc_id is not null").groupBy("doc_id", "class").count().where("count > 1").select(F.col("doc_id").alias("twice")).distinct())
    if not twice.limit(1).count():
        return left
    twice = _small(twice)
    again = left.join(twice, left[id_col].cast("long") == twice["twice"], "left_semi")
    return left.join(twice, left[id_col].cast("long") == twice["twice"], "left_anti").unionByName(again.dropDuplicates([id_col, text_col]))
