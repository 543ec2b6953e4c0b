"""Operator 7: quality by base rules and a hashed n-gram logistic regression.

Features of a text are the shares of its hashed words, character 3-grams and character 4-grams, each group hashed into
its own 2**HASH_BITS cells, so the linear score is a sum of mean weights and is read off in one vectorised pass over the
text. It is trained on a bounded sample of labelled rows: the SAMPLE_ROWS labelled documents of smallest hashed id. A
fifth of the sample is kept out of training and calibrates the score to a probability (Platt scaling). A document is kept
if no base rule fails and the probability reaches a fixed threshold.

Defined cases: null and empty texts, and texts of blanks, have no words and fail the base rules; without usable labels
(none, or of one class) only the base rules decide; a document labelled twice counts twice; repeated rows give repeated
rows; an empty table gives an empty table; other columns are ignored; the whole of every text is read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, chunks, texts, words

HASH_BITS, GROUPS = 15, 3
SAMPLE_ROWS, KEEP_AT = 2_000, 0.5
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(split: list[bytes], n: int = 3) -> int:
    """Words in windows of n words that the text has twice or more."""
    windows = list(zip(*(split[i:] for i in range(n)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, c in Counter(windows).items() if c > 1}
    total = reached = 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + n - max(i, reached)
            reached = i + n
    return total


def base_counts(text: str | None, split: list[bytes]) -> tuple[int, int, int, int, int]:
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(split), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(split)


def base_failed(n_words: int, n_repeat: int, min_words: int = 50, max_repeat_share: int = 50) -> bool:
    return n_words < min_words or 100 * n_repeat > max_repeat_share * n_words


def cells(text: str, split: list[bytes]) -> list[np.ndarray]:
    """Hashed cells of each group's features, one entry an occurrence."""
    mask = np.uint32((1 << HASH_BITS) - 1)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = [np.fromiter(map(zlib.crc32, split), np.uint32, len(split)) & mask]
    for n, multipliers in ((3, (2654435761, 2246822519, 3266489917)), (4, (668265263, 374761393, 2654435761, 2246822519))):
        m = len(c) - n + 1
        if m <= 0:
            out.append(np.zeros(0, np.uint32))
            continue
        h = c[:m] * np.uint32(multipliers[0])
        for i in range(1, n):
            h = (h ^ (h >> np.uint32(15))) + c[i : m + i] * np.uint32(multipliers[i])
        out.append((h ^ (h >> np.uint32(13))) & mask)
    return out


class Regression:
    """weights: (GROUPS, cells); the probability is the logistic function of slope * score + shift."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def score(self, groups: list[np.ndarray]) -> float:
        return self.bias + sum(float(w[g].mean()) for w, g in zip(self.weights, groups, strict=True) if len(g))

    def probability(self, groups: list[np.ndarray]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.score(groups) + self.shift, -50, 50))))


def fit(rows: list[tuple[int, list[int], list[float]]], rounds: int = 80, rate: float = 1.0, ridge: float = 1e-6) -> Regression | None:
    """rows: (label, feature numbers, shares). Full-batch Adam; every fifth row calibrates."""
    train, held = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if i % 5 == 0]
    if len({r[0] for r in train}) < 2:
        return None

    def matrix(part):
        return np.array([r[0] for r in part], np.float64), np.concatenate([np.asarray(r[1], np.int32) for r in part]), np.concatenate([np.asarray(r[2], np.float32) for r in part]), np.repeat(np.arange(len(part)), [len(r[1]) for r in part])

    y, at, share, row = matrix(train)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    size = GROUPS << HASH_BITS
    w, m, v, bias = np.zeros(size), np.zeros(size), np.zeros(size), 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[at] * share, len(y)) + bias
        e = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        g = np.bincount(at, e[row] * share, size) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= 0.5 * e.sum()
    y, at, share, row = matrix(held if len({r[0] for r in held}) == 2 else train)
    slope, shift = platt(np.bincount(row, w[at] * share, len(y)) + bias, y)
    return Regression(w.reshape(GROUPS, -1), bias, slope, shift)


def platt(score: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through scores, with Platt's smoothed targets, by damped Newton steps."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    spread = score.std() or 1.0
    x, ab = np.stack([score / spread, np.ones(len(score))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -50, 50)))
        ab -= np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - target)).clip(-5, 5)
    return float(ab[0] / spread), float(ab[1])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Regression | None:
    """The regression of a bounded sample; only hashed shares of the sample reach the driver."""
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    rows = F.broadcast(sample).join(texts(docs), "doc_id").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, share = [], []
            for t in batch.column("text").to_pylist():
                mine, parts = [], []
                for k, g in enumerate(cells(t, words(t))):
                    cell, n = np.unique(g, return_counts=True)
                    mine.append(cell.astype(np.int64) + (k << HASH_BITS))
                    parts.append((n / max(1, len(g))).astype(np.float32))
                at.append(np.concatenate(mine).astype(np.int32))
                share.append(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], names=["doc_id", "label", "at", "share"])

    got = rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, at array<int>, share array<float>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    order = np.argsort([zlib.crc32(str(i).encode()) for i in got["doc_id"].to_pylist()], kind="stable")
    at, share, label = got["at"].combine_chunks(), got["share"].combine_chunks(), got["label"].to_pylist()
    return fit([(label[i], at[int(i)].values.to_numpy(), share[int(i)].values.to_numpy()) for i in order]) if label else None


def judge(docs: DataFrame, model: Regression | None, keep_at: float = KEEP_AT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, the base counts, base_failed, probability, kept); the probability is null without a model."""
    sent = docs.sparkSession.sparkContext.broadcast(model and (model.weights.astype(np.float32), model.bias, model.slope, model.shift))
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("probability", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Regression(*sent.value) if sent.value else None
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for t in part.column("text").to_pylist():
                    split = words(t)
                    counts = base_counts(t, split)
                    failed = base_failed(counts[0], counts[4])
                    p = held.probability(cells(t or "", split)) if held else None
                    rows.append((*counts, failed, p, not failed and (p is None or p >= keep_at)))
                columns = zip(*rows, strict=True) if rows else [()] * (len(schema) - 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return texts(docs, text_col, id_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, probability double, kept boolean")
