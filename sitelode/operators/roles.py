"""What an element is called: kind, identity and role, numbered within its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..functions.urls import href_tail

# What must be equal for equal results.
STABLE_ATTRIBUTES = ("data-testid", "data-test-id", "data-test", "data-qa", "data-cy", "data-automation-id")
INTERACTIVE_TAGS = ("input", "button", "select", "textarea")
INTERACTIVE_ROLES = ("button", "link", "textbox", "searchbox", "checkbox", "radio", "combobox", "listbox", "menuitem", "tab", "switch", "slider", "option")
INPUT_KINDS = {
    "": "textbox", "text": "textbox", "email": "textbox", "password": "textbox", "tel": "textbox", "url": "textbox", "number": "textbox", "search": "searchbox",
    "checkbox": "checkbox", "radio": "radio", "submit": "button", "button": "button", "reset": "button", "image": "button", "file": "file", "range": "slider",
}
TAG_KINDS = {"button": "button", "a": "link", "select": "combobox", "textarea": "textbox"}


def attribute(name: str) -> Column:
    """An attribute; null and empty are the same."""
    return F.nullif(F.col("attributes")[name], F.lit(""))


def lowered(name: str) -> Column:
    return F.lower(F.coalesce(F.col("attributes")[name], F.lit("")))


def visible() -> Column:
    return F.coalesce(F.col("computed.visible"), F.lit(True))


def enabled() -> Column:
    return F.coalesce(F.col("computed.enabled"), F.lit(True))


def has_attribute(name: str) -> Column:
    return F.coalesce(F.map_contains_key("attributes", F.lit(name)), F.lit(False))


def looked_up(key: Column, table: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key], other)


def is_healable() -> Column:
    """Whether a script would act on the element."""
    stable = F.lit(False)
    for a in STABLE_ATTRIBUTES:
        stable = stable | attribute(a).isNotNull()
    link = F.coalesce(attribute("href"), F.nullif(F.col("computed.href"), F.lit(""))).isNotNull()
    other = F.col("tag").isin(*INTERACTIVE_TAGS) | lowered("role").isin(*INTERACTIVE_ROLES) | stable
    return visible() & ~((F.col("tag") == "input") & (lowered("type") == "hidden")) & F.when(F.col("tag") == "a", link).otherwise(other)


def element_kind() -> Column:
    by_tag = F.when(F.col("tag") == "input", looked_up(lowered("type"), INPUT_KINDS, F.lit("textbox"))).otherwise(looked_up(F.col("tag"), TAG_KINDS, F.col("tag")))
    return F.when(lowered("role") != "", lowered("role")).otherwise(by_tag)


def identity() -> Column:
    """A stable attribute as it is, else the first candidate that a slug can be made of."""
    value = F.when(lowered("type").isin("submit", "button"), attribute("value"))
    candidates = (attribute("aria-label"), F.col("name"), F.col("dom_context.nearby_label_text"), F.col("text_content"), attribute("placeholder"), value, attribute("title"), F.col("id_normalized"), href_tail(F.coalesce(attribute("href"), F.col("computed.href"))))
    return F.coalesce(*(attribute(a) for a in STABLE_ATTRIBUTES), *(F.when(slug(c) != "", c) for c in candidates), F.lit(""))


def derive_role() -> Column:
    s = slug(identity())
    return F.when(s == "", element_kind()).otherwise(F.concat(element_kind(), F.lit(":"), s))


def assign_roles(elements: DataFrame, page: str = "page_id") -> DataFrame:
    """Healable elements with base_role and role: repeats within a page are numbered #2, #3 in document order."""
    nth = F.row_number().over(Window.partitionBy(page, "base_role").orderBy("doc_idx"))
    found = elements.where(is_healable()).withColumn("base_role", derive_role()).withColumn("nth", nth)
    return found.withColumn("role", F.when(F.col("nth") == 1, F.col("base_role")).otherwise(F.concat("base_role", F.lit("#"), F.col("nth").cast("string")))).drop("nth")
