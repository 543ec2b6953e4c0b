"""Operator 8: toxicity by compression distance under two zstandard dictionaries.

Both dictionaries hold the commonest unmarked words of the labelled sample; the toxic one also holds what marks toxic text: word
beginnings and words that far more toxic than ordinary documents have, by a two-proportion z score, as cover-style
training would pick its segments. A text is read in overlapping windows of WINDOW words. Each window is compressed under
both dictionaries, and the difference of the two lengths says how much better the toxic dictionary explains it. The
histogram of differences over the whole text, with the largest ones, goes through a logistic curve fitted on the sample,
which turns it into a probability; 0.3 and above is predicted toxic.

The sample is bounded: of the labelled rows given, the TOXIC_ROWS toxic and ORDINARY_ROWS ordinary ones of smallest
hashed id. The curve weighs ordinary rows back to their true share.

Defined cases: null and empty texts and texts of blanks score like a text of one empty window, which differs by nothing;
without labels of both classes every score is 0; repeated rows give repeated rows; an empty table gives an empty table;
other columns are ignored; every window of a long text counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_out, texts

TOXIC_ROWS, ORDINARY_ROWS = 1_500, 3_500
WINDOW, STRIDE = 6, 3
COMMON_WORDS, MARKS, MARK_WORDS = 400, 300, 40
LEAST_Z, OF_BEST_Z = 5.0, 0.25
PUNCTUATION = b".,!?;:"
AT = 0.3


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(None, PUNCTUATION).split()


def windows(split: list[bytes], size: int = WINDOW, stride: int = STRIDE) -> list[bytes]:
    return [b" " + b" ".join(split[i : i + size]) + b" " for i in range(0, max(1, len(split) - size + stride), stride)]


def segments(split: list[bytes]) -> set[bytes]:
    """Words between blanks, and beginnings of words of 4 to 10 bytes."""
    out = set()
    for w in set(split):
        out.add(b" " + w + b" ")
        out.update(b" " + w[:n] for n in range(4, min(11, len(w))))
    return out


def marks(toxic: Counter, ordinary: Counter, n_toxic: int, n_ordinary: int) -> list[bytes]:
    """Segments that tell toxic documents, best first, none within another."""
    scored = []
    for s, n in toxic.items():
        if n >= 3 and len(s) >= 5:
            m = ordinary[s]
            p = (n + m) / (n_toxic + n_ordinary)
            scored.append(((n / n_toxic - m / n_ordinary) / np.sqrt(p * (1 - p) * (1 / n_toxic + 1 / n_ordinary) + 1e-12), s))
    scored.sort(key=lambda x: (-x[0], -len(x[1]), x[1]))
    chosen: list[bytes] = []
    for z, s in scored:
        if z < max(LEAST_Z, OF_BEST_Z * scored[0][0]) or len(chosen) == MARKS:
            break
        if not any(s in c or c in s for c in chosen):
            chosen.append(s)
    return chosen


def dictionaries(toxic_texts: list[list[bytes]], ordinary_texts: list[list[bytes]]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents; what matters most stands last, where references are cheapest."""
    a, b, common = Counter(), Counter(), Counter()
    for t in toxic_texts:
        a.update(segments(t))
    for t in ordinary_texts:
        b.update(segments(t))
    for t in (*toxic_texts, *ordinary_texts):
        common.update(set(t))
    found = marks(a, b, len(toxic_texts), len(ordinary_texts))
    ordinary_words = (w for w in sorted(common, key=lambda w: (-common[w], w)) if not any(s in b" " + w + b" " for s in found))
    base = list(islice(ordinary_words, COMMON_WORDS))[::-1]
    extra: list[bytes] = []
    for s in found:
        if s.endswith(b" "):
            extra.append(s.strip())
        else:  # a beginning: the words it begins in toxic text, commonest first
            extra += [w.strip() for w in sorted((w for w in a if w.startswith(s) and w.endswith(b" ")), key=lambda w: (-a[w], w))[:MARK_WORDS]]
    return b" " + b" ".join(base) + b" ", b" " + b" ".join(base + extra[::-1]) + b" "


def _compressor(content: bytes):
    import zstandard as z

    held = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    how = z.ZstdCompressionParameters.from_level(3, min_match=5, strategy=z.STRATEGY_GREEDY, window_log=17, source_size=64, dict_size=len(content), write_checksum=False, write_content_size=False, write_dict_id=False)
    return z.ZstdCompressor(dict_data=held, compression_params=how)


class Distances:
    """Features of texts under a pair of dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.one, self.two = _compressor(ordinary), _compressor(toxic)

    def features(self, split: list[bytes]) -> np.ndarray:
        one, two = self.one.compress, self.two.compress
        d = np.fromiter((len(one(w)) - len(two(w)) for w in windows(split)), np.int64)
        most = np.zeros(4)
        top = np.sort(d)[::-1][:4]
        most[: len(top)] = np.clip(top, -2, 12)
        shares = np.bincount(np.clip(d, -2, 9) + 2, minlength=12) / len(d)
        return np.concatenate([np.log1p(100 * shares), most, most[:2] >= 4])


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, spread, coefficients) of a ridge-penalised logistic curve, by Newton steps."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    x = np.c_[(x - mean) / spread, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), 0.5 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve(x.T * (weight * p * (1 - p)) @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
    return mean, spread, w


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS):
    """The model of the labelled rows given, or None if they lack one class. Its sample's texts are read by the driver:
    a bounded number of rows, each reduced to its words."""
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = marked.where("label = 1").orderBy(*order).limit(toxic_rows).unionByName(marked.where("label = 0").orderBy(*order).limit(ordinary_rows))
    total = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    got = sorted((r["label"], zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"] or "") for r in F.broadcast(sample).join(texts(docs), "doc_id").toLocalIterator())
    toxic, ordinary = [tokens(r[3]) for r in got if r[0] == 1], [tokens(r[3]) for r in got if r[0] == 0]
    if not toxic or not ordinary:
        return None
    pair = dictionaries(toxic, ordinary)
    distances = Distances(*pair)
    x = np.array([distances.features(t) for t in (*toxic, *ordinary)])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    weight = np.where(y == 1, total[1] / len(toxic), total[0] / len(ordinary))
    return (*pair, *fit_curve(x, y, weight * len(y) / weight.sum()))


def score(docs: DataFrame, model, text_col: str = "text", id_col: str = "doc_id", at: float = AT) -> DataFrame:
    """(doc_id, score, predicted)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        if held:
            distances, (mean, spread, w) = Distances(*held[:2]), held[2:]
        for batch in batches:
            for part in chunks(batch):
                p = np.zeros(part.num_rows)
                if held and part.num_rows:
                    x = np.array([distances.features(tokens(t)) for t in part.column("text").to_pylist()])
                    p = 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / spread, np.ones(len(x))] @ w, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= at).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts(docs, text_col, id_col).mapInArrow(run, "doc_id long, score double, predicted int")


def score_corpus(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from the labelled rows that aren't held out."""
    return score(docs, train(docs, labels.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "score", "predicted")
