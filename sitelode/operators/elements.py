"""Operators on element rows: counts, links, structural hash, frames, page documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import frame_origin, is_page_url, normalize_id, normalize_url


def with_ids(elements: DataFrame) -> DataFrame:
    """Element rows with id_normalized beside id."""
    return elements.withColumn("id_normalized", normalize_id("id"))


def ancestors(selector: Column) -> Column:
    """Selectors of the ancestors that a selector names, nearest first."""
    parts = F.split(selector, " > | ")
    marks = F.regexp_extract_all(selector, F.lit("( > | )"), F.lit(1))
    joined = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.flatten(F.zip_with(F.slice(parts, 1, n), F.concat(F.slice(marks, 1, n - 1), F.array(F.lit(""))), lambda p, m: F.array(p, m))), ""))
    return F.when(F.size(parts) > 1, F.reverse(joined)).otherwise(F.array().cast("array<string>"))


def links(elements: DataFrame) -> DataFrame:
    """(page_id, url, doc_idx): crawlable targets of a page's elements, hidden ones too, each at its first place."""
    target = F.explode(F.array(normalize_url(F.col("computed.href"))))  # a generator's output is worked out once, filters don't repeat it
    found = elements.where(F.coalesce(F.col("computed.href"), F.lit("")) != "").select("page_id", target.alias("url"), "doc_idx")
    return found.where(F.col("url").isNotNull() & is_page_url("url")).groupBy("page_id", "url").agg(F.min("doc_idx").alias("doc_idx"))


def _counted(name: str, key: Column) -> Column:
    """A map of counts by key, keys in order. The counts are added up per page from rows already grouped by key."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("what") == name, F.struct(key, F.col("n")))))).alias(f"by_{name}")


def element_counts(elements: DataFrame) -> DataFrame:
    """(page_id, total, visible, in_shadow_root, by_tag, by_frame). Here a missing visibility is not visible."""
    rows = elements.select("page_id", "tag", F.array_join("iframe_path", "/").alias("frame"), F.coalesce(F.col("computed.visible"), F.lit(False)).cast("long").alias("v"), (F.size("shadow_path") > 0).cast("long").alias("s"))
    flat = rows.groupBy("page_id", "tag", "frame").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum("s").alias("s"))
    keyed = flat.select("page_id", "v", "s", "n", F.explode(F.array(F.struct(F.lit("tag").alias("what"), F.col("tag").alias("key")), F.struct(F.lit("frame").alias("what"), F.col("frame").alias("key")))).alias("k"))
    keyed = keyed.groupBy("page_id", "k.what", "k.key").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("s").alias("s"))
    mine = F.col("what") == "tag"
    return keyed.groupBy("page_id").agg(
        F.sum(F.when(mine, F.col("n"))).alias("total"), F.sum(F.when(mine, F.col("v"))).alias("visible"), F.sum(F.when(mine, F.col("s"))).alias("in_shadow_root"),
        _counted("tag", F.col("key")), _counted("frame", F.col("key")),
    )


def _json_string(text: Column) -> Column:
    """A JSON string with the escapes of the hash's text form: to_json writes the ASCII ones, the rest become \\uXXXX."""
    plain = F.regexp_replace(F.regexp_replace(F.to_json(F.array(text)), r"^\[", ""), r"\]$", "")
    escaped = F.array_join(F.transform(F.split(plain, ""), lambda c: F.when((F.length(c) > 0) & (c > "\x7f"), _escaped(c)).otherwise(c)), "")
    return F.when(plain.rlike("[^\x00-\x7f]"), escaped).otherwise(plain)


def _escaped(c: Column) -> Column:
    units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
    return F.regexp_replace(units, "(....)", r"\\u$1")


def structural_hash(elements: DataFrame) -> DataFrame:
    """(page_id, structural_hash) from the set of element signatures: text, list lengths, volatile ids and classes don't matter."""
    def text(c) -> Column:
        return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))

    signature = F.struct(
        F.col("tag").alias("a"), text("dom_context.parent_tag").alias("b"), text("id_normalized").alias("c"), text("name").alias("d"), text(F.col("attributes")["type"]).alias("e"), text(F.col("attributes")["role"]).alias("f"),
        F.size("iframe_path").alias("g"), (F.size("shadow_path") > 0).alias("h"),
    )
    sets = elements.select("page_id", signature.alias("s")).groupBy("page_id").agg(F.array_sort(F.collect_set("s")).alias("s"))
    written = F.transform("s", lambda s: F.concat(F.lit("["), F.array_join(F.array(*(_json_string(s[k]) for k in "abcdef"), s["g"].cast("string"), s["h"].cast("string")), ", "), F.lit("]")))
    return sets.select("page_id", F.substring(F.sha2(F.concat(F.lit("["), F.array_join(written, ", "), F.lit("]")), 256), 1, 16).alias("structural_hash"))


def page_documents(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a page with its elements nested in document order, and the summary counts; pages: page_id, url and more."""
    row = F.struct("doc_idx", *(c for c in elements.columns if c not in ("page_id", "page_url", "doc_idx")))
    nested = elements.groupBy("page_id").agg(F.array_sort(F.collect_list(row), lambda a, b: a["doc_idx"] - b["doc_idx"]).alias("elements"))
    counts = element_counts(elements).select("page_id", F.struct("total", "visible", "in_shadow_root", "by_tag", "by_frame").alias("element_counts"))
    return pages.join(nested, "page_id").join(counts, "page_id").join(structural_hash(elements), "page_id")


def detected_platform(elements: DataFrame) -> DataFrame:
    """(page_id, platform) of the first element that shows one."""
    return elements.where(F.col("platform_signal.platform").isNotNull()).groupBy("page_id").agg(F.min_by(F.col("platform_signal.platform"), "doc_idx").alias("platform"))


def frame_tree(frames: DataFrame) -> DataFrame:
    """Readable frames of captured pages, and those that aren't with the reason.

    frames: (page_id, frame_id, parent_id, pos, name, url, readable). A frame is reached only over an unbroken chain of
    frames of its page's origin. path is the labels from the top; equal labels under one parent are numbered #2, #3.
    """
    spark = frames.sparkSession
    label = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("frame"), F.col("pos").cast("string")))
    named = frames.withColumn("base", F.when(F.col("parent_id").isNull(), "main").otherwise(label)).withColumn("origin", frame_origin("url"))
    return spark.sql(
        """
        WITH RECURSIVE numbered AS (
          SELECT *, row_number() OVER (PARTITION BY page_id, parent_id, base ORDER BY pos, frame_id) AS nth FROM {named}),
        labelled AS (SELECT *, CASE WHEN nth = 1 THEN base ELSE concat(base, '#', nth) END AS label FROM numbered),
        tree(page_id, frame_id, path, origin, skip_reason) AS (
          SELECT page_id, frame_id, array(label), origin, CAST(CASE WHEN NOT readable THEN 'unreadable' END AS STRING) FROM labelled WHERE parent_id IS NULL
          UNION ALL
          SELECT c.page_id, c.frame_id, concat(t.path, array(c.label)), coalesce(c.origin, t.origin),
            CASE WHEN t.skip_reason IN ('cross_origin', 'inside_cross_origin_frame') THEN 'inside_cross_origin_frame'
                 WHEN c.origin IS NOT NULL AND c.origin <> t.origin THEN 'cross_origin'
                 WHEN NOT c.readable THEN 'unreadable' END
          FROM tree t JOIN labelled c ON c.page_id = t.page_id AND c.parent_id = t.frame_id)
        SELECT * FROM tree""",
        named=named,
    )
