"""The training-text pipeline over `documents`: language, repeated lines, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of `documents`. A stage's
result is written as Parquet and read again as the next one's docs, in the folder named by spark.checkpoint.dir.

Defined cases, for every stage: an empty table gives an empty table; columns besides those of `documents` are carried by all
stages but the last, whatever their names; a null id is kept as it is. Each stage states what nulls, ties and repeated rows
come to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm import jaccard_join, language_id, line_dedup, packing, pii
from sitelode.llm.common import held_out, table
from sitelode.llm.queries import tokenizer_path
from sitelode.llm.scratch import kept
from sitelode.shipping import shipped

#: Least score of a language: below it no n-gram is in any profile, as one that is gives 1 / DEPTH ** 2 (1.1e-5) at least.
LEAST_SCORE = 1e-6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null texts, texts without letters, and texts none of whose n-grams any profile holds.

    Repeated rows are judged alike; of equally near languages the first by name is taken, which removes nobody."""
    return language_id.accepted(docs, language_id.profiles(docs.where(~held_out())), LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go, everywhere. A null text has one empty line, which never goes, and stays null; a
    line repeated in one document counts once; repeated rows count as documents."""
    return line_dedup.dedup_corpus(docs, shape="rows")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest id stays; of rows that repeat an id and a text one stays. Null and
    empty texts link with nothing and stay; rows without an id stay."""
    return jaccard_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced in the texts. Null texts stay null; of overlapping spans the first names
    the placeholder; repeated rows each count and are each replaced."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, laid into sequences. A null text has the closing id alone; repeated rows are packed each for
    itself."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [(name, shipped(stage)) for name, stage in (("language", language), ("lines", lines), ("near_copies", near_copies), ("personal_data", personal_data), ("packing", pack))]

#: Languages, the join and packing can't be put into SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
