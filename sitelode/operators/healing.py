"""Fingerprints of elements, finding them again in a later snapshot, and the record of what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sequence_ratio, text_similarity, xpath_tags
from ..functions.urls import normalize_id, normalize_url
from ..scratch import kept
from .roles import STABLE_ATTRIBUTES, assign_roles, visible

# What must be equal for equal results.
WEIGHTS = {"stable_attr": 0.25, "name": 0.12, "text": 0.12, "aria_label": 0.10, "label": 0.12, "attributes": 0.08, "dom_path": 0.08, "id": 0.04, "classes": 0.04, "parent": 0.03, "sibling_index": 0.02}
TRUSTED = ("stable_attr", "id", "name", "aria_label")
VOLATILE = (
    "style", "tabindex", "data-reactid", "data-react-checksum", "aria-describedby", "aria-labelledby", "aria-controls", "aria-owns", "aria-activedescendant",
    "aria-expanded", "aria-selected", "aria-checked", "aria-pressed", "aria-hidden", "jsname", "jscontroller", "jsaction",
)
COVERED = (*STABLE_ATTRIBUTES, "aria-label", "class", "id", "name")
VOLATILE_PREFIXES = ("data-v-", "_ngcontent", "_nghost", "ng-", "data-react", "data-emotion")
THRESHOLD, MARGIN, EVIDENCE_TARGET, AGREEMENT, MIN_EVIDENCE, MEANING = 0.5, 0.05, 0.5, 0.9, 0.2, 0.6
MOST_TAGS = 1000
CANVAS_SHARE, CANVAS_AREA, CANVAS_CONTROLS = 0.4, 90_000, 3
FIELDS = ("tag", "id", "id_normalized", "name", "classes", "attributes", "text_content", "xpath", "css_selector", "iframe_path", "shadow_path", "dom_context")


def fingerprints(elements: DataFrame) -> DataFrame:
    """(page_url, element_role, record_seq, fingerprint fields): the healable elements of pages under their roles."""
    return assign_roles(elements).select("page_url", F.col("role").alias("element_role"), F.col("doc_idx").alias("record_seq"), *FIELDS)


def record(store: DataFrame, found: DataFrame, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new store, summary of added, refreshed, kept). Without refresh what is stored stays; with it, it is replaced in its place."""
    key = ["page_url", "element_role"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("record_seq"))
    found = found.withColumn("_n", nth).where("_n = 1").drop("_n").select(store.columns)
    new = found.join(store.select(key), key, "left_anti")
    old = store.join(found.select(key), key, "left_semi")
    kept = store
    if refresh:
        held = store.select(*key, F.col("record_seq").alias("_seq"))
        kept = store.join(found.select(key), key, "left_anti").unionByName(found.join(held, key).withColumn("record_seq", F.col("_seq")).select(store.columns))
    both = new.select(F.lit(1).alias("a"), F.lit(0).alias("o")).unionByName(old.select(F.lit(0).alias("a"), F.lit(1).alias("o")))
    summary = both.agg(F.coalesce(F.sum("a"), F.lit(0).cast("long")).alias("added"), F.coalesce(F.sum("o"), F.lit(0).cast("long")).alias("_old"))
    summary = summary.select("added", (F.col("_old") if refresh else F.lit(0).cast("long")).alias("refreshed"), (F.lit(0).cast("long") if refresh else F.col("_old")).alias("kept"))
    return kept.unionByName(new), summary


def attribute_selector(name: str, value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit(f'[{name}="'), escaped, F.lit('"]'))


def locators() -> Column:
    """array<struct<strategy, kind, value, raw>> in priority order, without the absent ones."""
    def given(c: Column | str) -> Column:
        return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))

    def one(strategy: str, kind: str, raw: Column, value: Column | None = None) -> Column:
        return F.struct(F.lit(strategy).alias("strategy"), F.lit(kind).alias("kind"), (raw if value is None else value).alias("value"), raw.alias("raw"))

    found = [one(f"stable_attr:{a}", "css", v, attribute_selector(a, v)) for a in STABLE_ATTRIBUTES for v in [given(F.col("attributes")[a])]]
    aria = given(F.col("attributes")["aria-label"])
    found += [one("id", "css", given("id"), attribute_selector("id", given("id"))), one("name", "css", given("name"), attribute_selector("name", given("name"))), one("aria_label", "css", aria, attribute_selector("aria-label", aria))]
    found += [one("css", "css", given("css_selector")), one("xpath", "xpath", given("xpath")), one("normalized_id", "id_pattern", F.when(~F.col("id_normalized").eqNullSafe(F.col("id")), given("id_normalized"))), one("text", "text", given("text_content"))]
    return F.filter(F.array(*found), lambda x: x["raw"].isNotNull())


def describe_locator() -> Column:
    first = F.try_element_at(locators(), F.lit(1))
    return F.coalesce(F.concat(first["strategy"], F.lit("="), first["value"]), F.lit(""))


def _comparable(attributes: Column) -> Column:
    def identity(k: Column) -> Column:
        out = ~k.isin(*COVERED, *VOLATILE)
        for p in VOLATILE_PREFIXES:
            out = out & ~F.startswith(k, F.lit(p))
        return out

    return F.map_filter(attributes, lambda k, v: identity(k))


def similarities(old: str = "old", new: str = "new") -> dict[str, Column]:
    """Similarity of two structs of fingerprint fields by signal; null where a side has nothing to compare."""
    o, n = F.col(old), F.col(new)

    def both(get) -> tuple[Column, Column]:
        return F.nullif(get(o), F.lit("")), F.nullif(get(n), F.lit(""))

    def alike(get) -> Column:
        return text_similarity(*both(get))

    stable_same, stable_any = F.lit(False), F.lit(False)
    for a in STABLE_ATTRIBUTES:
        x, y = both(lambda s, a=a: s["attributes"][a])
        stable_any = stable_any | (x.isNotNull() & y.isNotNull())
        stable_same = stable_same | F.coalesce(x == y, F.lit(False))
    oid, nid = both(lambda s: s["id"])
    normal = [F.coalesce(s["id_normalized"], normalize_id(s["id"])) for s in (o, n)]
    om, nm = _comparable(o["attributes"]), _comparable(n["attributes"])
    shared = F.array_intersect(F.map_keys(om), F.map_keys(nm))
    agreeing = F.size(F.filter(shared, lambda k: F.coalesce(om[k] == nm[k], F.lit(False))))
    def path(s: Column) -> Column:
        return F.when(F.size(s["dom_context"]["tag_path"]) > 0, s["dom_context"]["tag_path"]).otherwise(xpath_tags(s["xpath"]))

    half = F.when(~o["iframe_path"].eqNullSafe(n["iframe_path"]), 0.5).otherwise(1.0) * F.when(~o["shadow_path"].eqNullSafe(n["shadow_path"]), 0.5).otherwise(1.0)
    same_path = F.when((path(o) == path(n)) & (F.size(path(o)) > 0), 1.0).otherwise(sequence_ratio(path(o), path(n)))
    pt, pn = both(lambda s: s["dom_context"]["parent_tag"])
    it, in_ = both(lambda s: s["dom_context"]["parent_id"])
    parts = F.filter(F.array((pt == pn).cast("double"), (normalize_id(it) == normalize_id(in_)).cast("double")), lambda x: x.isNotNull())
    return {
        "stable_attr": F.when(stable_any, stable_same.cast("double")), "name": alike(lambda s: s["name"]), "text": alike(lambda s: s["text_content"]), "aria_label": alike(lambda s: s["attributes"]["aria-label"]),
        "label": alike(lambda s: s["dom_context"]["nearby_label_text"]), "attributes": F.when(F.size(shared) > 0, agreeing / F.size(shared)), "dom_path": same_path * half,
        "id": F.when(oid.isNotNull() & nid.isNotNull(), F.when(oid == nid, 1.0).when(normal[0] == normal[1], 0.8).otherwise(0.0)),
        "classes": F.when((F.size(o["classes"]) > 0) & (F.size(n["classes"]) > 0), F.size(F.array_intersect(o["classes"], n["classes"])) / F.size(F.array_union(o["classes"], n["classes"]))),
        "parent": F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)),
        "sibling_index": 1.0 / (1 + F.abs(o["dom_context"]["sibling_index"] - n["dom_context"]["sibling_index"])),
    }


def scored(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Pairs with sim_* for each signal, raw, evidence and confidence. Elements of another tag score nothing."""
    named = similarities(old, new)
    pairs = pairs.select("*", *(c.cast("double").alias(f"sim_{k}") for k, c in named.items()))
    weight, total = F.lit(0.0), F.lit(0.0)
    for k, w in WEIGHTS.items():
        weight = weight + F.when(F.col(f"sim_{k}").isNotNull(), w).otherwise(0.0)
        total = total + F.coalesce(F.col(f"sim_{k}") * w, F.lit(0.0))
    other = F.coalesce(F.col(f"{old}.tag") != F.col(f"{new}.tag"), F.lit(False))
    pairs = pairs.withColumn("_w", F.when(other, 0.0).otherwise(weight)).withColumn("_t", total)
    raw = F.when(F.col("_w") > 0, F.col("_t") / F.col("_w")).otherwise(0.0)
    evidence = F.least(F.lit(1.0), F.col("_w") / EVIDENCE_TARGET)
    return pairs.withColumn("confidence", F.round(raw * evidence, 4)).withColumn("raw", F.round(raw, 4)).withColumn("evidence", F.round(evidence, 4)).drop("_w", "_t")


def explained() -> Column:
    """Of rows of scored(): each signal's similarity to three places, null where the two can't be compared."""
    return F.create_map(*(x for k in WEIGHTS for x in (F.lit(k), F.round(F.col(f"sim_{k}"), 3))))


def coverage(pages: DataFrame, store: DataFrame) -> DataFrame:
    """(page_url, stored): how many fingerprints the store (page_url, ...) has of each page (url), by canonical URL."""
    wanted = pages.select(normalize_url("url").alias("page_url")).where("page_url is not null").distinct()
    held = store.groupBy("page_url").agg(F.count("*").alias("stored"))
    return wanted.join(held, "page_url", "left").select("page_url", F.coalesce("stored", F.lit(0)).alias("stored"))


def offered(name: str) -> Column:
    """The weight of the signals that a fingerprint has something to compare for: what a comparison with itself weighs."""
    s = F.col(name)

    def given(c: Column) -> Column:
        return F.nullif(c, F.lit("")).isNotNull()

    stable = F.lit(False)
    for a in STABLE_ATTRIBUTES:
        stable = stable | given(s["attributes"][a])
    context = s["dom_context"]
    has = {
        "stable_attr": stable, "name": given(s["name"]), "text": given(s["text_content"]), "aria_label": given(s["attributes"]["aria-label"]), "label": given(context["nearby_label_text"]),
        "attributes": F.size(_comparable(s["attributes"])) > 0, "dom_path": (F.size(context["tag_path"]) > 0) | (F.size(xpath_tags(s["xpath"])) > 0), "id": given(s["id"]), "classes": F.size(s["classes"]) > 0,
        "parent": given(context["parent_tag"]) | given(context["parent_id"]), "sibling_index": context["sibling_index"].isNotNull(),
    }
    weight = F.lit(0.0)
    for k, w in WEIGHTS.items():
        weight = weight + F.when(has[k], w).otherwise(0.0)
    return weight


def canvas_pages(elements: DataFrame) -> DataFrame:
    """Pages (page_url) that are drawn: a canvas or plugin surface takes most of them and hardly a control stands outside."""
    e = elements.where(visible()).withColumn("_area", F.coalesce(F.col("computed.bounding_box.width") * F.col("computed.bounding_box.height"), F.lit(0.0)))
    page = Window.partitionBy("page_url")
    main = (F.array_join("iframe_path", "/") == "main") & F.col("tag").isin("body", "html")
    e = e.withColumn("_page", F.max(F.when(main, F.col("_area")).otherwise(0.0)).over(page))
    surface = F.col("tag").isin("canvas", "object", "embed", "applet") & (F.col("_area") >= F.when(F.col("_page") > 0, F.col("_page") * CANVAS_SHARE).otherwise(CANVAS_AREA))
    key = F.concat(F.array_join("iframe_path", "/"), F.lit("\x02"), F.coalesce("css_selector", F.lit("")))
    e = e.withColumn("_surface", surface).withColumn("_key", key).withColumn("_keys", F.collect_set(F.when(surface & (F.col("css_selector") != ""), key)).over(page))
    within = F.exists("_keys", lambda k: F.startswith(F.col("_key"), F.concat(k, F.lit(" "))))
    control = (F.col("tag").isin("input", "button", "select", "textarea") | ((F.col("tag") == "a") & (F.coalesce("computed.href", F.lit("")) != ""))) & (F.coalesce(F.col("attributes")["type"], F.lit("")) != "hidden") & ~within
    return e.groupBy("page_url").agg(F.bool_or("_surface").alias("s"), F.count_if(control).alias("n")).where(F.col("s") & (F.col("n") <= CANVAS_CONTROLS)).select("page_url")


def _as_struct(name: str) -> Column:
    return F.struct(*FIELDS).alias(name)


def _side(df: DataFrame, name: str, *keep: str) -> DataFrame:
    """The fields under names of their own: unlike those of a struct, what isn't read doesn't travel."""
    return df.select(*keep, *(F.col(f).alias(f"{name}_{f}") for f in FIELDS))


def _scored_sides(pairs: DataFrame) -> DataFrame:
    return scored(pairs.withColumns({name: F.struct(*(F.col(f"{name}_{f}").alias(f) for f in FIELDS)) for name in ("old", "new")}))


def _tags(df: DataFrame, tag: str) -> list | None:
    """The distinct tags, where they are few enough to be named in a filter."""
    met = [r[0] for r in df.select(tag).distinct().limit(MOST_TAGS + 1).collect()]
    return met if len(met) <= MOST_TAGS else None


def _of_tags(elements: DataFrame, met: list | None) -> DataFrame:
    """The elements of the tags met: what can't be compared doesn't travel."""
    if met is None:
        return elements
    named = F.col("tag").isin(*(t for t in met if t is not None))
    return elements.where(named | F.col("tag").isNull() if None in met else named)


def _tries(store: DataFrame, elements: DataFrame) -> DataFrame:
    """(page_url, element_role, tries): the locators, by rank k, that find a single element of a frame, with its doc_idx and tag.

    Both sides travel once, by page; what is grouped afterwards is of one page.
    """
    frame = F.array_join("iframe_path", "/").alias("frame")
    bare = lambda l: F.struct(l["strategy"].alias("strategy"), l["raw"].alias("raw"), (l["kind"] == "text").alias("tagged"))
    normal = F.when(F.col("id_normalized").isNotNull(), F.struct(F.lit("normalized_id").alias("strategy"), F.col("id_normalized").alias("raw"), F.lit(False).alias("tagged")))
    marks = F.concat(F.transform(F.filter(locators(), lambda l: l["strategy"] != "normalized_id"), bare), F.filter(F.array(normal), lambda l: l.isNotNull()))
    asked = store.select(F.lit(True).alias("asks"), "page_url", "element_role", F.lit(None).cast("int").alias("doc_idx"), frame, "tag", F.transform(locators(), bare).alias("ls"))
    found = elements.select(F.lit(False).alias("asks"), "page_url", F.lit(None).cast("string").alias("element_role"), F.col("doc_idx").cast("int").alias("doc_idx"), frame, "tag", marks.alias("ls"))
    both = asked.where("element_role is not null").unionByName(found).where("page_url is not null").repartition("page_url")
    each = both.select("*", F.posexplode("ls").alias("k", "l")).select("*", "l.*").withColumn("t", F.when(F.col("tagged"), F.col("tag")))
    met = each.groupBy("page_url", "strategy", "raw", "t").agg(
        F.collect_list(F.when(F.col("asks"), F.struct("element_role", "k", "frame"))).alias("askers"), F.array_sort(F.collect_list(F.when(~F.col("asks"), F.struct("frame", "doc_idx", "tag")))).alias("places")
    ).where((F.size("askers") > 0) & (F.size("places") > 0))

    def alone(x: Column, i: Column) -> Column:
        """Whether no neighbour in the order is of the same frame."""
        before, after = F.get("places", i - 1), F.get("places", i + 1)
        return ~F.coalesce((i > 0) & before["frame"].eqNullSafe(x["frame"]), F.lit(False)) & ~((i + 1 < F.size("places")) & after["frame"].eqNullSafe(x["frame"]))

    single = met.select("page_url", "strategy", F.filter("places", alone).alias("places"), F.explode("askers").alias("a"))
    mine = F.filter("places", lambda x: (F.col("a.frame") == "") | (x["frame"] == F.col("a.frame")))
    first = F.array_min(F.transform(mine, lambda x: F.struct(x["doc_idx"].alias("doc_idx"), x["tag"].alias("tag"))))
    hits = single.select("page_url", "a.element_role", "a.k", "strategy", first.alias("p")).where("p is not null")
    return hits.groupBy("page_url", "element_role").agg(F.array_sort(F.collect_list(F.struct("k", "strategy", "p.doc_idx", "p.tag"))).alias("tries"))


def outcomes(store: DataFrame, elements: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """resolve() without the two sides: (page_url, element_role, outcome, kind, strategy, confidence, reason, doc_idx).

    What one step leaves to the next is written, so that no plan holds more than one step.
    """
    key = ["page_url", "element_role"]
    nothing = F.lit(None).cast("string")
    tries = kept(_tries(store, elements))
    best_try = F.col("tries")[0]
    trusted = (best_try["k"] == 0) & F.substring_index(best_try["strategy"], ":", 1).isin(*TRUSTED)
    sure = tries.where(trusted).select(*key, F.lit("exact").alias("outcome"), nothing.alias("kind"), best_try["strategy"].alias("strategy"), F.lit(None).cast("double").alias("confidence"), best_try["doc_idx"].alias("doc_idx"))
    open_ = tries.where(~trusted).select(*key, F.explode("tries").alias("l")).select(*key, "l.*")
    held, live = _side(store, "old", *key), elements.select("*", F.col("tag").alias("_tag"))
    places = _side(_of_tags(live, _tags(open_, "tag")), "new", "page_url", "doc_idx")
    found = _scored_sides(open_.drop("tag").join(held, key).join(places, ["page_url", "doc_idx"]))
    found = found.withColumn("offered", F.least(F.lit(1.0), offered("old") / EVIDENCE_TARGET))
    holds = (F.col("offered") >= MIN_EVIDENCE) & (F.col("evidence") >= F.col("offered") - 1e-4) & (F.col("raw") >= max(AGREEMENT, threshold))
    taken = found.where((F.col("confidence") >= threshold) | holds).groupBy(key).agg(F.min(F.struct("k", "strategy", "confidence", "doc_idx")).alias("l")).select(*key, "l.*")
    taken = taken.select(*key, F.when(F.col("k") == 0, "exact").otherwise("healed").alias("outcome"), F.when(F.col("k") > 0, "fallback").alias("kind"), "strategy", "confidence", "doc_idx")
    taken = kept(sure.unionByName(taken)).withColumn("reason", nothing)
    left = kept(store.select(*key, "tag").join(taken.select(key), key, "left_anti"))
    met = _tags(left, "tag")
    asking = left.where("tag is not null").withColumnRenamed("tag", "_tag").join(held, key)
    others = _side(_of_tags(live, met), "new", "page_url", "_tag", "doc_idx")
    rivals = asking.join(others, ["page_url", "_tag"])
    if met is None or None in met:  # rare: elements of any tag compare
        untagged = left.where("tag is null").drop("tag").join(held, key).join(_side(live, "new", "page_url", "_tag", "doc_idx"), "page_url")
        rivals = rivals.unionByName(untagged)
    by = Window.partitionBy(*key).orderBy(F.desc("confidence"), "doc_idx")
    best = _scored_sides(rivals).select(*key, "confidence", "doc_idx").withColumn("_n", F.row_number().over(by)).withColumn("_rival", F.lead("confidence").over(by)).where("_n = 1").drop("_n")
    best = left.select(key).join(best, key, "left").join(canvas_pages(elements).withColumn("_drawn", F.lit(True)), "page_url", "left")
    weak = F.col("confidence").isNull() | (F.col("confidence") < threshold)
    close = (F.col("_rival") >= threshold) & (F.col("confidence") - F.col("_rival") < margin)
    refused = weak | F.coalesce(close, F.lit(False))
    reason = F.when(refused, F.when(F.col("_drawn"), "unsupported_rendering").when(weak, "below_threshold").otherwise("ambiguous"))
    rest = best.select(
        *key, F.when(refused, "failed").otherwise("healed").alias("outcome"), F.when(~refused, "scored").alias("kind"), F.when(~refused, "weighted_score").alias("strategy"), "confidence",
        F.when(~refused, F.col("doc_idx")).alias("doc_idx"), reason.alias("reason"),
    )
    return taken.unionByName(rest).select(*key, "outcome", "kind", "strategy", "confidence", "reason", "doc_idx")


def resolve(store: DataFrame, elements: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """Where each fingerprint's element is in a snapshot of its page. The store has one row a key, as record() leaves it.

    Locators are tried by equality in their order: one that finds a single element of a frame is taken, the first
    one at once if its kind is trusted, others if the element resembles the stored one. What no locator finds is
    compared with every element of its tag on the page; a best one below the threshold, or with a rival close
    behind, is refused. Gives (page_url, element_role, outcome, kind, strategy, confidence, reason, doc_idx, old, new).
    """
    o = outcomes(store, elements, threshold, margin)
    held = store.select(F.col("page_url").alias("_p"), F.col("element_role").alias("_r"), _as_struct("old"))
    both = o.join(held, F.col("page_url").eqNullSafe(F.col("_p")) & F.col("element_role").eqNullSafe(F.col("_r"))).drop("_p", "_r")
    return both.join(elements.select("page_url", "doc_idx", _as_struct("new")), ["page_url", "doc_idx"], "left").select(*o.columns, "old", "new")


def changes(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Pairs with changed_fields, in order, and change_kind: regression if what a user sees or what the element is changed."""
    o, n = F.col(old), F.col(new)

    def field(name: str) -> Column:
        return F.when(~o[name].eqNullSafe(n[name]), name)

    names = F.array_sort(F.array_union(F.map_keys(o["attributes"]), F.map_keys(n["attributes"])))
    attributes = F.transform(F.filter(names, lambda k: ~o["attributes"][k].eqNullSafe(n["attributes"][k])), lambda k: F.concat(F.lit("attributes."), k))
    context = F.array(*(F.when(~o["dom_context"][k].eqNullSafe(n["dom_context"][k]), f"dom_context.{k}") for k in ("nearby_label_text", "parent_id", "parent_tag", "sibling_index", "tag_path")))
    plain = F.array(*map(field, ("tag", "id", "id_normalized", "name", "text_content", "xpath", "css_selector", "classes", "iframe_path", "shadow_path")))
    listed = F.filter(F.concat(plain, attributes, context), lambda x: x.isNotNull())

    def differs(get) -> Column:
        x, y = F.nullif(get(o), F.lit("")), F.nullif(get(n), F.lit(""))
        return F.coalesce(x != y, F.lit(False))

    def unlike(get) -> Column:
        return F.coalesce(text_similarity(F.nullif(get(o), F.lit("")), F.nullif(get(n), F.lit(""))), F.lit(1.0)) < MEANING

    worse = ~o["tag"].eqNullSafe(n["tag"]) | differs(lambda s: s["attributes"]["type"]) | differs(lambda s: s["attributes"]["role"])
    for get in (lambda s: s["text_content"], lambda s: s["attributes"]["aria-label"], lambda s: s["attributes"]["placeholder"], lambda s: s["dom_context"]["nearby_label_text"]):
        worse = worse | unlike(get)
    return pairs.withColumn("changed_fields", listed).withColumn("change_kind", F.when(worse, "regression").otherwise("churn"))


def heal(store: DataFrame, resolved: DataFrame, at: Column, run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new store, history rows) for the healed rows of resolve()."""
    key = ["page_url", "element_role"]
    healed = changes(resolved.where("outcome = 'healed'"))
    history = healed.select(*key, at.alias("at"), "kind", "strategy", F.round("confidence", 3).alias("confidence"), "change_kind", "changed_fields", F.col("old").alias("old_fingerprint"), F.col("new").alias("new_fingerprint"), F.lit(run_id).cast("string").alias("run_id"))
    fresh = healed.select(*key, "new.*").join(store.select(*key, "record_seq"), key).select(store.columns)
    return store.join(healed.select(key), key, "left_anti").unionByName(fresh), history


def churn_report(history: DataFrame) -> DataFrame:
    """Per element heals, regressions, churn, last_healed_at; most healed first, then most recently met first.

    history: (id, page_url, element_role, at, change_kind), the larger id the newer.
    """
    rows = history.groupBy(F.concat("page_url", F.lit("#"), "element_role").alias("element_key")).agg(
        F.count("*").alias("heals"), F.count_if(F.col("change_kind") == "regression").alias("regressions"), F.max("at").alias("last_healed_at"), F.max("id").alias("_met")
    )
    return rows.orderBy(F.desc("heals"), F.desc("_met")).select("element_key", "heals", "regressions", (F.col("heals") - F.col("regressions")).alias("churn"), "last_healed_at")


def history_rows(history: DataFrame, limit: int | None = None, **equal: str | None) -> DataFrame:
    """Newest first, with optional equality filters."""
    for name, value in equal.items():
        if value is not None:
            history = history.where(F.col(name) == value)
    history = history.orderBy(F.desc("id"))
    return history if limit is None else history.limit(limit)
