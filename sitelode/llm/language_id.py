"""Operator 6: language identification by rank-order n-gram profiles.

A profile is a language's most frequent character n-grams in falling order, counted over all labelled training texts
with words padded by blanks. A text is ranked the same way, and its distance to a language is the sum of how far each of
its n-grams is out of place there; an n-gram the profile lacks counts as `depth` places. The nearest language wins, the
first by name among equals. Its score is 1 - distance / (depth * n-grams compared).

Defined cases: a null text, and one without letters, is `und` with score 0; null languages aren't learned from; a corpus
without training rows gives `und` everywhere; repeated rows give repeated rows; an empty table gives an empty table;
other columns are ignored; the whole of every text counts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, held_out, texts
from .scratch import kept

LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Lengths of the n-grams, n-grams in a profile, n-grams a worker holds, characters counted at a time.
MAX_N, DEPTH, HELD_GRAMS, SLICE = 4, 300, 1_000_000, 1_000_000
#: Languages of one broadcast; texts are read once for each broadcast.
LANGUAGES = 200


_ALPHA = np.zeros(1 << 16, bool)
_ALPHA[[c for c in range(1 << 16) if chr(c).isalpha()]] = True
_SPACE = np.uint64(32)


def grams(word: str, max_n: int = MAX_N) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in range(1, max_n + 1) for i in range(len(padded) - n + 1)]


def code(gram: str) -> int:
    """Up to four characters as 16 bits each: codes are in the order of the n-grams."""
    out = 0
    for c in gram.ljust(4, "\0"):
        out = out << 16 | ord(c)
    return out


def gram_of(code: int) -> str:
    return "".join(chr(c) for c in (code >> 48, code >> 32 & 0xFFFF, code >> 16 & 0xFFFF, code & 0xFFFF) if c)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    each, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return each, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def counted(text: str, max_n: int = MAX_N) -> tuple[np.ndarray, np.ndarray] | None:
    """(codes in order, counts) of a lower-case text's n-grams, or None where codes can't tell: letters beyond 16 bits, or
    n-grams longer than four."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if max_n > 4:
        return None
    if len(letters) and letters.max() > 0xFFFF:
        if any(chr(c).isalpha() for c in set(letters[letters > 0xFFFF].tolist())):
            return None
        letters = np.where(letters > 0xFFFF, np.uint32(32), letters)
    alpha = _ALPHA[letters]
    # one blank for each run of other characters, and one at either end: it closes a word and opens the next
    alpha = np.concatenate([[False], alpha, [False]])
    line = np.concatenate([[32], letters, [32]]).astype(np.uint64)
    line[~alpha] = _SPACE
    line = line[alpha | np.concatenate([[True], alpha[:-1]])]
    parts = []
    for i in range(0, max(1, len(line) - 1), SLICE):
        s = line[i : i + SLICE + max_n - 1]
        most = min(SLICE, len(line) - i)  # n-grams that begin in this slice
        here, inner = [], np.ones(len(s), bool)
        key = s << np.uint64(48)
        here.append(key[:most][s[:most] != _SPACE])
        for n in range(2, max_n + 1):
            key = key[:-1] | s[n - 1 :] << np.uint64(64 - 16 * n)
            if n > 2:
                inner = inner[:-1] & (s[n - 2 : -1] != _SPACE)
            else:
                inner = inner[:-1]
            here.append(key[:most][inner[:most]])
        all_ = np.sort(np.concatenate(here))
        if len(all_):
            begin = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))
            parts.append((all_[begin], np.diff(begin, append=len(all_))))
    return _merged(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def plainly(text: str, max_n: int = MAX_N) -> Counter:
    """The same counts by n-gram, for any letters."""
    out: Counter = Counter()
    for word, n in Counter(LETTERS.findall(text)).items():
        for part in [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split():
            for g in grams(part, max_n):
                out[g] += n
    out.pop(" ", None)
    return out


def profiles(docs: DataFrame, max_n: int = MAX_N, depth: int = DEPTH, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, rank): counted over every row with a language; workers count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        rare: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang in {*held, *rare}:
                codes, n = _merged(held.pop(lang)) if lang in held else (np.zeros(0), np.zeros(0))
                total = Counter(dict(zip(map(gram_of, codes.tolist()), n.tolist(), strict=True)))
                total.update(rare.pop(lang, {}))
                counts = list(total.items())
                for i in range(0, len(counts), 50_000):
                    part = counts[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([g for g, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for part in chunks(batch):
                of_lang: dict[str, list[str]] = defaultdict(list)
                for lang, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    of_lang[lang].append(t.lower())
                for lang, ts in of_lang.items():
                    if (found := counted("\n".join(ts), max_n)) is not None:
                        held[lang].append(found)
                    else:
                        for t in ts:
                            rare[lang].update(plainly(t, max_n))
                if sum(len(c) for parts in held.values() for c, _ in parts) > HELD_GRAMS:
                    for lang in held:
                        held[lang] = [_merged(held[lang])]
                    if sum(len(c) for parts in held.values() for c, _ in parts) + sum(map(len, rare.values())) > HELD_GRAMS // 2:
                        yield from out()
        yield from out()

    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= depth).select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Profiles:
    def __init__(self, rows: list[tuple[str, str, int]], max_n: int, depth: int):
        self.langs, self.max_n, self.depth = sorted({r[0] for r in rows}), max_n, depth
        self.of_gram = {g: i for i, g in enumerate(sorted({r[1] for r in rows}))}
        self.ranks = np.full((len(self.of_gram) + 1, len(self.langs)), -1, np.int32)  # the last: of no profile
        column = {x: i for i, x in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[self.of_gram[gram], column[lang]] = rank
        short = [g for g in self.of_gram if len(g) <= 4 and all(ord(c) <= 0xFFFF for c in g)]
        self.codes = np.array([code(g) for g in short], np.uint64)  # sorted, as the n-grams are
        self.numbers = np.array([self.of_gram[g] for g in short], np.int64)

    def ranked(self, text: str) -> np.ndarray:
        """Profile numbers of a text's most frequent n-grams, in falling order and then by n-gram."""
        none = len(self.ranks) - 1
        found = counted(text, self.max_n)
        if found is None:
            top = sorted(plainly(text, self.max_n).items(), key=lambda x: (-x[1], x[0]))[: self.depth]
            return np.array([self.of_gram.get(g, none) for g, _ in top], np.int64)
        codes, n = found
        if len(codes) > self.depth:
            often = n >= np.partition(n, -self.depth)[-self.depth]
            codes, n = codes[often], n[often]
        codes = codes[np.argsort(-n, kind="stable")[: self.depth]]
        if not len(self.codes):
            return np.full(len(codes), none)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.numbers[at], none)

    def predict(self, text: str | None) -> tuple[str, float]:
        own = self.ranked(text.lower()) if text and self.langs else ()
        if not len(own):
            return UNDETERMINED, 0.0
        ranks = self.ranks[own]
        places = np.arange(len(own), dtype=np.int32)[:, None]
        distance = np.where(ranks < 0, self.depth, np.abs(ranks - places)).sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.depth * len(own)))


def _sent(docs: DataFrame, learned: DataFrame, depth: int) -> list:
    """Profiles as broadcasts of at most LANGUAGES languages each, `depth` rows a language."""
    langs = sorted(r["lang"] for r in learned.select("lang").distinct().collect())
    parts = [langs[i : i + LANGUAGES] for i in range(0, len(langs), LANGUAGES)] or [[]]
    return [docs.sparkSession.sparkContext.broadcast([tuple(r) for r in learned.where(F.col("lang").isin(p)).limit(LANGUAGES * depth).collect()]) for p in parts]


def _told(rows: DataFrame, sent, max_n: int, depth: int) -> DataFrame:
    """(doc_id, lang_pred, score) of (doc_id, text) by one broadcast of profiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(sent.value, max_n, depth)
        for batch in batches:
            for part in chunks(batch):
                out = [model.predict(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def _best(rows: DataFrame, sent: list, max_n: int, depth: int) -> DataFrame:
    """(row, lang_pred, score) of written (row, text): the best over several broadcasts of profiles."""
    each = [_told(rows.select(F.col("row").alias("doc_id"), "text"), s, max_n, depth) for s in sent]
    all_ = each[0]
    for more in each[1:]:
        all_ = all_.unionByName(more)
    best = all_.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("worse"), F.col("lang_pred"))).alias("best"))
    return best.select(F.col("doc_id").alias("row"), "best.lang_pred", (-F.col("best.worse")).alias("score"))


def predict(docs: DataFrame, learned: DataFrame, max_n: int = MAX_N, depth: int = DEPTH, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score), given profiles."""
    sent = _sent(docs, learned, depth)
    rows = texts(docs, text_col, id_col)
    if len(sent) == 1:
        return _told(rows, sent[0], max_n, depth)
    rows = kept(rows.withColumn("row", F.monotonically_increasing_id()))
    return rows.select("row", "doc_id").join(_best(rows, sent, max_n, depth), "row").drop("row")


def accepted(docs: DataFrame, learned: DataFrame, min_score: float = 0.0, max_n: int = MAX_N, depth: int = DEPTH, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language can be told with at least min_score."""
    sent = _sent(docs, learned, depth)
    if len(sent) > 1:
        held = kept(docs.select(F.struct(*docs.columns).alias("all"), docs[text_col].cast("string").alias("text"), F.monotonically_increasing_id().alias("row")))
        good = _best(held, sent, max_n, depth).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score))
        return held.join(good.select("row"), "row", "left_semi").select("all.*")
    one = sent[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(one.value, max_n, depth)
        for batch in batches:
            for part in chunks(batch):
                told = [model.predict(t) for t in part.column(text_col).to_pylist()]
                yield part.filter(pa.array([x != UNDETERMINED and s >= min_score for x, s in told], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, max_n: int = MAX_N, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows of `docs` that aren't held out, predicted for all."""
    learned = profiles(docs.where(~held_out()), max_n, depth)
    return predict(docs, learned, max_n, depth).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
