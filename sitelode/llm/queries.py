"""The queries of the ten operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, jaccard_join, language_id, line_dedup, packing, pii, quality_rules, sentencepiece_codec, token_counts, toxicity
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_corpus(table(spark, sf_dir, "documents"), shape="digest")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_packing, op3_line_dedup, op4_token_counts, op5_pii, op6_language_id, op7_quality_rules, op8_toxicity, op9_jaccard_join, op10_fingerprints)
}
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL: dict[str, str] = {
    "op3_line_dedup": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
      l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d), k AS (SELECT *, translate(trim(line, {_BLANKS}), {_UPPER}, {_LOWER}) AS key FROM l),
      f AS (SELECT key, count(DISTINCT r) >= 10 AND key <> '' AS often FROM k GROUP BY key)
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (often) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT often), '')) AS kept_sha256 FROM k JOIN f USING (key) GROUP BY r, doc_id""",
    "op9_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
      s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
      t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
      p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
      e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p), r(node, reach) AS (SELECT DISTINCT x, x FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach)
      SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(min(r.reach), s.doc_id) AS component_id FROM s LEFT JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.s)""",
}
