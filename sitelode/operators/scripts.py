"""Specifications of page scripts: what each element is called and what a script does with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import url_part
from .roles import assign_roles, element_kind, enabled, has_attribute, lowered, visible

# What must be equal for equal results.
FILL_KINDS = ("textbox", "searchbox")
CLICK_KINDS = ("button", "link", "checkbox", "radio", "tab", "menuitem", "switch")
SUBMIT = r"(?i)sign[\s_-]*in|log[\s_-]*in|submit|save|search|continue|next|pay|order|register|sign[\s_-]*up|create|send|apply|confirm|go$"
SAMPLES = {"email": "user@example.com", "tel": "5551234567", "number": "1", "url": "https://example.com", "search": "test", "date": "2026-01-01"}
SAMPLE, MAX_ELEMENTS = "sample text", 200


def snake(text: Column) -> Column:
    s = F.lower(F.btrim(F.regexp_replace(text, "[^a-zA-Z0-9]+", "_"), F.lit("_")))
    return F.when(s == "", "element").when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


def pascal(text: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(text, "[^a-zA-Z0-9]+"), lambda p: p != ""), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.regexp_replace(p, "^.", "")))), "")


def page_stem(url: Column) -> Column:
    """A readable name of a URL: its last two path segments without extensions, or home."""
    parts = F.transform(F.filter(F.split(url_part(url, "path"), "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, r"(?i)\.[a-z0-9]{1,5}$", ""))
    stem = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), " ")
    return F.when(pascal(stem) == "", "home").when(stem.rlike(r"^\p{L}"), stem).otherwise(F.concat(F.lit("item "), stem))


def element_specs(elements: DataFrame, page_types: DataFrame, max_elements: int = MAX_ELEMENTS) -> DataFrame:
    """(page_id, nth, role, kind, action, value, method, visible, enabled, submit) of up to max_elements a page.

    Methods are numbered where a name is taken on the page. value is what a fill types: a sample, or the name of an
    environment variable in braces for credentials.
    """
    c, page = F.col, Window.partitionBy("page_id").orderBy("doc_idx")
    e = assign_roles(elements).withColumn("nth", F.row_number().over(page)).where(c("nth") <= max_elements).join(page_types.select("page_id", "page_type"), "page_id", "left")
    writable = c("tag").isin("input", "textarea") & ~has_attribute("readonly")
    action = F.when(element_kind().isin(*FILL_KINDS) & enabled() & writable, "fill").when(element_kind().isin(*CLICK_KINDS) & enabled(), "click").otherwise("locate")
    e = e.withColumn("kind", element_kind()).withColumn("action", action)
    user = (c("action") == "fill") & (c("page_type") == "login") & (lowered("type") != "password")
    e = e.withColumn("_user", user).withColumn("_first_user", c("_user") & (F.count_if(c("_user")).over(page) == 1))
    sample = F.coalesce(F.create_map(*(F.lit(x) for kv in SAMPLES.items() for x in kv))[lowered("type")], F.lit(SAMPLE))
    value = F.when(c("action") == "fill", F.when(lowered("type") == "password", "{PASSWORD}").when(c("_first_user"), "{USERNAME}").otherwise(sample))
    label = F.btrim(F.concat_ws(" ", F.nullif("text_content", F.lit("")), F.nullif(c("attributes")["value"], F.lit("")), F.nullif(c("attributes")["aria-label"], F.lit(""))))
    submit = (c("action") == "click") & ((lowered("type") == "submit") | (c("tag").isin("button", "input") & label.rlike(SUBMIT)))
    name = F.regexp_replace(F.when(F.contains("role", F.lit(":")), F.regexp_replace("role", "^[^:]*:", "")).otherwise(""), "#.*$", "")
    suffix = F.when(F.contains("role", F.lit("#")), F.concat(F.lit("_"), F.regexp_replace("role", "^.*#", ""))).otherwise("")
    e = e.withColumn("_base", F.concat(c("action"), F.lit("_"), snake(F.when(name == "", c("kind")).otherwise(name)), suffix)).withColumn("_s", submit)
    twin = F.row_number().over(Window.partitionBy("page_id", "_base").orderBy("doc_idx"))
    e = e.withColumn("_twin", twin)
    return e.select(
        "page_id", "nth", "role", "kind", "action", value.alias("value"), F.when(c("_twin") == 1, c("_base")).otherwise(F.concat("_base", F.lit("_"), c("_twin").cast("string"))).alias("method"),
        visible().alias("visible"), enabled().alias("enabled"), (c("_s") & (F.count_if(c("_s")).over(page) == 1)).alias("submit"),
    )


def page_specs(elements: DataFrame, page_types: DataFrame, max_elements: int = MAX_ELEMENTS) -> DataFrame:
    """One row a page: names, its elements, how many were left out, and the steps: all fills, then the first submit if any fill."""
    specs = element_specs(elements, page_types, max_elements)
    total = assign_roles(elements).groupBy("page_id", "page_url").agg(F.count("*").alias("n"))
    row = F.struct("nth", "role", "kind", "method", "action", "value", "visible", "enabled")
    rows = specs.groupBy("page_id").agg(F.array_sort(F.collect_list(row)).alias("elements"), F.min_by("role", F.when(F.col("submit"), F.col("nth"))).alias("_submit"))
    fills = F.transform(F.filter("elements", lambda x: x["action"] == "fill"), lambda x: F.struct(F.lit("fill").alias("action"), x["role"].alias("role"), x["value"].alias("value")))
    last = F.when((F.size(fills) > 0) & F.col("_submit").isNotNull(), F.array(F.struct(F.lit("click").alias("action"), F.col("_submit").alias("role"), F.lit(None).cast("string").alias("value")))).otherwise(F.array().cast("array<struct<action:string,role:string,value:string>>"))
    out = rows.join(total, "page_id").join(page_types.select("page_id", "page_type"), "page_id", "left")
    stem = page_stem(F.col("page_url"))
    return out.select("page_id", F.col("page_url").alias("url"), "page_type", F.concat(pascal(stem), F.lit("Page")).alias("class_name"), snake(stem).alias("function_name"), "elements", F.greatest(F.col("n") - max_elements, F.lit(0)).alias("truncated"), F.concat(fills, last).alias("steps"))
