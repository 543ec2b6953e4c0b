"""What different user roles reach: pages and elements that some have and others lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .roles import assign_roles


def reached(pages: DataFrame) -> DataFrame:
    """(role, url) of manifests (role, url, status, variant_urls): pages that didn't fail, and their variants."""
    return pages.where("status <> 'failed'").select("role", F.explode(F.concat(F.array("url"), F.coalesce("variant_urls", F.array().cast("array<string>")))).alias("url")).distinct()


def _split(have: Column, among: Column) -> tuple[Column, Column]:
    """Roles that have it and that miss it, both in the order of `among`."""
    return F.filter(among, lambda r: F.array_contains(have, r)), F.filter(among, lambda r: ~F.array_contains(have, r))


def page_differences(visits: DataFrame, roles: list[str]) -> DataFrame:
    """(url, roles, missing) for URLs that not every role reached; visits: (role, url)."""
    have, miss = _split(F.col("_have"), F.array(*map(F.lit, roles)))
    rows = visits.where(F.col("role").isin(roles)).groupBy("url").agg(F.collect_set("role").alias("_have")).where(F.size("_have") < len(roles))
    return rows.select("url", have.alias("roles"), miss.alias("missing"))


def element_differences(names: DataFrame, compared: DataFrame, roles: list[str]) -> DataFrame:
    """(url, element, roles, missing) on pages that two roles or more have read.

    names: (role, url, element); compared: (role, url) of the pages read, whether or not they have elements.
    """
    among = compared.where(F.col("role").isin(roles)).groupBy("url").agg(F.collect_set("role").alias("_all")).where(F.size("_all") >= 2)
    rows = names.join(compared.select("role", "url").distinct(), ["role", "url"], "left_semi").groupBy("url", "element").agg(F.collect_set("role").alias("_have")).join(among, "url")
    order = F.filter(F.array(*map(F.lit, roles)), lambda r: F.array_contains(F.col("_all"), r))
    have, miss = _split(F.col("_have"), order)
    return rows.select("url", "element", have.alias("roles"), miss.alias("missing")).where(F.size("missing") > 0)


def element_names(elements: DataFrame) -> DataFrame:
    """(role, url, element) from elements (role, page_url, ...): the numbered names of what a script would act on."""
    keyed = elements.withColumn("page_key", F.concat("role", F.lit("\x01"), "page_url")).withColumnRenamed("role", "_user")
    pages = assign_roles(keyed, "page_key")
    return pages.select(F.col("_user").alias("role"), F.col("page_url").alias("url"), F.col("role").alias("element")).distinct()


def summary(visits: DataFrame, page_diff: DataFrame, element_diff: DataFrame, roles: list[str]) -> DataFrame:
    """(role, pages_reached, only_pages, only_elements) for each role, in order."""
    known = visits.sparkSession.createDataFrame([(r, i) for i, r in enumerate(roles)], "role string, pos int")
    n = visits.groupBy("role").agg(F.count("*").alias("n"))
    def only(diff: DataFrame, name: str) -> DataFrame:
        return diff.where(F.size("roles") == 1).groupBy(F.col("roles")[0].alias("role")).agg(F.count("*").alias(name))

    rows = known.join(n, "role", "left").join(only(page_diff, "p"), "role", "left").join(only(element_diff, "e"), "role", "left").orderBy("pos")
    return rows.select("role", *(F.coalesce(c, F.lit(0).cast("long")).alias(a) for c, a in (("n", "pages_reached"), ("p", "only_pages"), ("e", "only_elements"))))
