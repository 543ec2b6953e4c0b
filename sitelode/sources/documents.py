"""Page documents as JSON, and versioned snapshots of the fingerprint store."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .html import ELEMENTS_DDL

SCHEMA_VERSION = 1


def document_schema() -> StructType:
    """The schema of page files; built when a session is there."""
    known = StructType.fromDDL(ELEMENTS_DDL + ", id_normalized string")
    element = StructType([f for f in known if f.name not in ("page_id", "page_url", "doc_idx")])
    head = "schema_version int, run_id string, url string, final_url string, page_type string, structural_hash string, captured_at string, _corrupt_record string"
    return StructType.fromDDL(head).add("elements", ArrayType(element))


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, unreadable ones) of page files; keys that aren't known are passed over."""
    docs = spark.read.schema(document_schema()).option("mode", "PERMISSIVE").option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    bad = F.col("_corrupt_record").isNotNull() | F.col("url").isNull()
    return docs.where(~bad).drop("_corrupt_record"), docs.where(bad).select("file")


def elements_of(documents: DataFrame) -> DataFrame:
    """Element rows of page documents; page_id is a hash of the URL."""
    rows = documents.select(F.xxhash64("url").alias("page_id"), F.coalesce("final_url", "url").alias("page_url"), F.posexplode("elements").alias("doc_idx", "e"))
    return rows.select("page_id", "page_url", "doc_idx", "e.*")


def write_pages(documents: DataFrame, path: str) -> None:
    documents.write.mode("errorifexists").json(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class SnapshotStore:
    """Fingerprints and history that change together: both go under a new snapshot, then a pointer of its number appears.

    The highest pointer counts, so a writer that fails leaves the last snapshot standing; pointers are made by a rename
    that fails where one is there already, so of two writers of one number the second starts again with the next.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> int | None:
        fs, p = _fs(self.spark, f"{self.root}/pointers")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        numbers = [int(n.split(".")[0]) for n in names if n.endswith(".json")]
        if not numbers:
            return None
        state = json.loads(self.spark.read.text(f"{self.root}/pointers/{max(numbers):012d}.json").first()[0])
        if state["version"] > SCHEMA_VERSION:
            raise RuntimeError(f"the store is of a newer version: {state['version']}")
        return state["snapshot"]

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._place(self.current())}/{table}")

    def _place(self, number: int) -> str:
        return json.loads(self.spark.read.text(f"{self.root}/pointers/{number:012d}.json").first()[0])["place"]

    def commit(self, fingerprints: DataFrame, history: DataFrame) -> int:
        mark = uuid.uuid4().hex
        place = f"snapshots/{mark}"
        for name, rows in (("fingerprints", fingerprints), ("history", history)):
            rows.write.parquet(f"{self.root}/{place}/{name}")
        while True:
            number = (self.current() or 0) + 1
            fs, new = _fs(self.spark, f"{self.root}/{place}/pointer.json")
            out = fs.create(new, True)
            out.write(bytearray(json.dumps({"version": SCHEMA_VERSION, "snapshot": number, "place": place}).encode()))
            out.close()
            _, at = _fs(self.spark, f"{self.root}/pointers/{number:012d}.json")
            fs.mkdirs(at.getParent())
            if not fs.exists(at) and fs.rename(new, at):
                return number
