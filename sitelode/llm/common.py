"""What the operators share: table readers, column safety, word rules and broadcast files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The blanks of the contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id long, text string): the only columns the operators look at, whatever else the table carries."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(LOWER)


def words(text: str | None) -> list[bytes]:
    """Maximal runs without blanks, in UTF-8. bytes.split() splits at exactly the six blanks of the contracts."""
    return text.encode().split() if text else []


def chunks(batch: pa.RecordBatch, rows: int = 512, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and about `limit` text bytes, so that a batch of long texts isn't held expanded at once."""
    n, total = batch.num_rows, batch.nbytes
    step = max(1, min(rows, int(n * limit / max(total, 1)) or 1))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def held_out(col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver and shipped to the executors; its size is fixed by the vocabulary, not by the data."""
    return Path(path).read_bytes()


class BoundedCache(dict):
    """A dict that is emptied when it reaches its bound: memory stays fixed however many distinct keys a worker meets."""

    def __init__(self, bound: int):
        super().__init__()
        self.bound = bound

    def room(self, n: int) -> None:
        if len(self) + n > self.bound:
            self.clear()
