"""Page types from elements: one row of features a page, nine scores with their evidence, one choice.

Containment is a question of selectors: an element is inside another of its frame if its selector goes on from the
other's. Elements carry the keys of their ancestors, and the keys of a kind of container are gathered over the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import page_direction, squeezed
from ..functions.urls import column, normalize_id, url_part
from .elements import ancestors
from .roles import attribute, enabled, has_attribute, lowered, visible

# What must be equal for equal results.
PAGE_TYPES = ("login", "dashboard", "list", "detail", "form", "search", "checkout", "nav_shell", "modal")
PRIORITY = ("modal", "login", "checkout", "search", "form", "list", "dashboard", "detail", "nav_shell")
MIN_SCORE, TIE_MARGIN = 0.5, 0.15
LOGIN_URL = r"/(log-?in|sign-?in|signin|auth|sso|session)(/|$)"
LOGIN_TEXT = r"\b(sign|log)[ -]?in\b|\bwelcome back\b"
SIGNUP_URL = r"/(register|sign-?up|join|create-?account)(/|$)"
SIGNUP_TEXT = r"\b(sign ?up|register|create (an )?account|join)\b"
OAUTH_URL = r"/oauth2?/|/authorize|/saml|/sso|/openid|/adfs/|login\.microsoftonline\.com|accounts\.google\.com|okta\.com|auth0\.com|[?&](response_type|client_id|redirect_uri)="
SSO_BUTTON = r"(sign|log) ?in with|continue with|single sign-?on|\bsso\b|use (your )?(google|microsoft|okta|github|apple)"
SUBMIT_TEXT = r"\b(sign ?in|log ?in|submit|save|send|continue|next|create|register|sign ?up|update|apply|pay|place order|search|join)\b"
PAYMENT_FIELD = r"cc-(number|exp|csc|name|type)|card[-_ ]?(number|num|holder|no)\b|cardnumber|\bcv[vc]\b|\bcsc\b|security[-_ ]?code|expir(y|ation)|exp[-_ ]?(date|month|year)|\biban\b|routing[-_ ]?number"
STEPPER = r"stepper|step[-_ ]?(indicator|nav|list|progress|\d)|checkout[-_ ]?(steps?|progress)|wizard|progress[-_ ]?(bar|tracker|steps)"
STEP_TEXT = r"\bstep \d+ (of|/) \d+\b"
CHECKOUT_URL = r"/(checkout|cart|payment|billing|order|pay|purchase)(/|$)"
CHECKOUT_TEXT = r"place order|pay now|complete (purchase|order)|order summary|proceed to (checkout|payment)|payment (method|details)"
SEARCH_INPUT = r"\b(search|query|keyword|q)\b"
FILTER = r"filter|facet|refine|\bsort\b"
RESULTS = r"search[-_ ]?results?|results?[-_ ]?(list|grid|container|area|count|wrapper)|\bresults\b|serp"
SEARCH_URL = r"/search\b|[?&](q|query|s|keyword|keywords)="
KPI = r"\b(kpi|metric|metrics|scorecard|stat|stats|statistic|tile|widget|summary)\b"
CHART = r"chart|graph|\bplot|sparkline|highcharts|recharts|apexcharts|echarts|plotly"
DASHBOARD_URL = r"/(dashboard|overview|analytics|insights|summary|reports?)(/|$)"
DASHBOARD_TEXT = r"\b(dashboard|overview|analytics|insights)\b"
PAGINATION = r"paginat|\bpager\b"
KEY_VALUE = r"\b(field|detail|property|attribute|info|meta)[-_](label|value|name|key)\b"
DETAIL_URL = r"/(details?|view|profile)(/|$)"
NON_FIELD_TYPES = ("hidden", "submit", "button", "reset", "image")
BUTTON_TYPES = ("submit", "button", "reset", "image")
TEXT_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "figcaption", "dd", "dt", "li", "td", "th")
PROSE_TAGS, PROSE_MIN = ("span", "div"), 20
ROW_TAGS = ("tr", "li", "article", "div", "section", "dd")
CHROME_TAGS = ("nav", "header", "footer", "aside")
CHROME_ROLES = ("navigation", "banner", "contentinfo", "menu", "menubar", "complementary")
MIN_ROWS, MIN_FORM_RATIO, MIN_Z, MIN_AREA, MIN_SHARE, MIN_HEIGHT = 5, 0.3, 100, 0.4, 0.6, 150


def has(text: Column, pattern: str) -> Column:
    return text.rlike("(?U)" + pattern)


def blob() -> Column:
    """What identifies an element, as one lower-case text."""
    parts = (F.nullif("id", F.lit("")), F.nullif("name", F.lit("")), F.array_join("classes", " "), *(attribute(a) for a in ("placeholder", "aria-label", "autocomplete", "title", "data-testid", "role")), F.nullif(lowered("type"), F.lit("")))
    return F.lower(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))


def nodes(elements: DataFrame) -> DataFrame:
    """Visible elements with what the rules ask about each."""
    t = lowered("type")
    text = F.when((F.coalesce("text_content", F.lit("")) == "") & (F.col("tag") == "input") & t.isin(*BUTTON_TYPES), F.coalesce(F.col("attributes")["value"], F.lit(""))).otherwise(F.coalesce("text_content", F.lit("")))
    frame, sel, box = F.array_join("iframe_path", "\x01"), F.coalesce("css_selector", F.lit("")), F.col("computed.bounding_box")
    up = ancestors(sel)
    n = elements.where(visible()).select(
        "page_id", "page_url", "doc_idx", "tag", t.alias("type"), lowered("role").alias("role"), blob().alias("blob"), squeezed(text).alias("text"), sel.alias("sel"),
        F.concat(frame, F.lit("\x02"), sel).alias("key"), F.transform(up, lambda a: F.concat(frame, F.lit("\x02"), a)).alias("up"), (frame == "main").alias("main"),
        F.coalesce("computed.readonly", F.lit(False)).alias("readonly"), enabled().alias("enabled"), F.array_join(F.array_sort("classes"), " ").alias("shape"),
        F.coalesce(F.nullif("computed.href", F.lit("")), attribute("href")).isNotNull().alias("linked"), lowered("rel").alias("rel"), F.coalesce(F.col("attributes")["aria-label"], F.lit("")).alias("aria"),
        (F.coalesce(F.col("attributes")["aria-current"], F.lit("")) == "step").alias("at_step"), ((lowered("aria-modal") == "true") | ((F.col("tag") == "dialog") & has_attribute("open"))).alias("modal"),
        F.coalesce(box["width"] * box["height"], F.lit(0.0)).alias("area"), F.coalesce(box["height"], F.lit(0.0)).alias("height"), F.col("computed.position").alias("position"), F.col("computed.z_index").alias("z"),
    )
    c = F.col
    n = n.withColumn("field", ((c("tag") == "input") & ~c("type").isin(*NON_FIELD_TYPES)) | c("tag").isin("textarea", "select"))
    n = n.withColumn("button", (c("tag") == "button") | (c("role") == "button") | ((c("tag") == "input") & c("type").isin(*BUTTON_TYPES)))
    n = n.withColumn("submit", c("button") & (((c("tag") == "input") & c("type").isin("submit", "image")) | ((c("tag") == "button") & ((c("type") == "submit") | ((c("type") == "") & has(c("text"), SUBMIT_TEXT))))))
    n = n.withColumn("link", (c("tag") == "a") & c("linked")).withColumn("heading", c("tag").isin("h1", "h2", "h3", "legend") & (c("text") != ""))
    n = n.withColumn("chrome", c("tag").isin(*CHROME_TAGS) | c("role").isin(*CHROME_ROLES))
    return n.withColumn("kpi", has(c("blob"), KPI)).withColumn("chart", (c("tag") == "canvas") | has(c("blob"), CHART))


def features(elements: DataFrame) -> DataFrame:
    """One row a page with everything the scores use."""
    c, page = F.col, Window.partitionBy("page_id")
    n = nodes(elements)

    def keys(which: Column) -> Column:
        return F.collect_set(F.when(which & (c("sel") != ""), c("key"))).over(page)

    n = n.withColumn("page_area", F.coalesce(F.max(F.when(c("main") & c("tag").isin("body", "html"), c("area"))).over(page), F.lit(0.0)))
    overlay = ~c("tag").isin("html", "body") & c("position").isin("fixed", "absolute") & (c("z") >= MIN_Z) & (c("page_area") > 0) & c("main") & (c("area") >= MIN_AREA * c("page_area"))
    n = n.withColumn("container", c("role").isin("dialog", "alertdialog") | c("modal") | F.coalesce(overlay, F.lit(False)))
    n = n.withColumn("tall", c("container") & (c("height") >= MIN_HEIGHT))
    n = n.select("*", keys(c("tag").isin("p", "blockquote", "figcaption")).alias("ps"), keys(c("chrome")).alias("chromes"), keys(c("kpi")).alias("kpis"), keys(c("chart")).alias("charts"), keys(c("tall")).alias("talls"))

    def inside(which: str) -> Column:
        return F.arrays_overlap("up", which)

    below = n.select("page_id", F.explode("up").alias("key")).groupBy("page_id", "key").agg(F.count("*").alias("below"))
    rows = n.where(c("tag").isin(*ROW_TAGS) & (c("sel") != "") & ~inside("chromes")).join(below, ["page_id", "key"], "left").where((c("tag") == "tr") | (c("below") >= 2))
    parent = F.coalesce(F.try_element_at("up", F.lit(1)), F.lit(""))
    rows = rows.groupBy("page_id", parent.alias("parent"), "tag", "shape").count().groupBy("page_id").agg(F.max("count").alias("rows"))

    def n_of(which: Column, name: str) -> Column:
        return F.count_if(which).alias(name)

    def any_of(which: Column, name: str) -> Column:
        return F.coalesce(F.bool_or(which), F.lit(False)).alias(name)

    said = (c("heading") | c("submit")) & (c("text") != "")
    label = F.when(c("text") != "", c("text")).otherwise(F.lower("aria"))
    control, way = c("link") | c("button"), page_direction(label)
    block = (c("text") != "") & (c("tag").isin(*TEXT_TAGS) | (c("tag").isin(*PROSE_TAGS) & (F.length("text") >= PROSE_MIN)))
    content = ~c("tag").isin("html", "body")
    f = n.groupBy("page_id").agg(
        F.first("page_url").alias("page_url"), n_of(c("field"), "fields"), n_of(c("field") & ~c("readonly") & c("enabled"), "editable"), n_of(c("field") & c("readonly"), "readonly"),
        n_of((c("tag") == "input") & (c("type") == "password"), "passwords"), n_of(c("button"), "buttons"), any_of(c("submit"), "submits"), n_of(c("link") & ~inside("ps"), "nav_links"),
        any_of(said & has(c("text"), LOGIN_TEXT), "login_said"), any_of(said & has(c("text"), SIGNUP_TEXT), "signup_said"), any_of(c("heading") & has(c("text"), LOGIN_TEXT), "login_headed"),
        any_of(control & (has(c("text"), SSO_BUTTON) | has(c("blob"), SSO_BUTTON)), "sso"), n_of(c("kpi") & ~inside("kpis"), "kpis"), n_of(c("chart") & ~inside("charts"), "charts"),
        any_of(c("heading") & has(c("text"), DASHBOARD_TEXT), "dashboard_headed"), n_of(c("tag") == "th", "ths"), n_of(c("tag") == "h1", "h1s"), n_of(c("tag") == "dt", "dts"),
        any_of(has(c("blob"), PAGINATION), "pager"), any_of(c("link") & c("rel").isin("next", "prev"), "rel_pager"), any_of(control & (way == "next"), "has_next"), any_of(control & (way == "prev"), "has_prev"),
        any_of(c("link") & (way == "next"), "next_link"), n_of(control & label.rlike(r"(?U)^\d{1,3}$"), "numbered"), n_of(has(c("blob"), KEY_VALUE), "key_values"), n_of(block, "text_blocks"), any_of(c("tag") == "form", "form"),
        any_of(c("field") & c("tag").isin("input", "textarea") & ((c("type") == "search") | (c("role") == "searchbox") | has(c("blob"), SEARCH_INPUT)), "search_input"),
        n_of(c("field") & ((c("tag") == "select") | c("type").isin("checkbox", "radio", "range")), "choices"), any_of(has(c("blob"), FILTER), "filter"), any_of(has(c("blob"), RESULTS), "results"),
        n_of(c("field") & has(c("blob"), PAYMENT_FIELD), "payment_fields"), any_of(has(c("blob"), STEPPER) | c("at_step") | has(c("text"), STEP_TEXT), "steps"), any_of(has(c("text"), CHECKOUT_TEXT), "checkout_said"),
        any_of((c("tag") == "nav") | (c("role") == "navigation"), "navs"), any_of(c("container"), "container"), F.max("page_area").alias("page_area"), F.max(F.when(c("tall"), c("area"))).alias("tall_area"),
        n_of(content, "content"), n_of(content & (c("tall") | inside("talls")), "held"),
    )
    f = f.join(rows, "page_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    url, path = F.lower(F.coalesce("page_url", F.lit(""))), F.lower(url_part(F.coalesce("page_url", F.lit("")), "path"))
    segments = F.filter(F.split(path, "/"), lambda s, i: (i >= 2) & (s != "") & (normalize_id(s) != s))
    return f.select(
        "*", has(path, LOGIN_URL).alias("login_url"), has(path, SIGNUP_URL).alias("signup_url"), has(url, OAUTH_URL).alias("oauth_url"), has(path, DASHBOARD_URL).alias("dashboard_url"),
        has(url, SEARCH_URL).alias("search_url"), has(path, CHECKOUT_URL).alias("checkout_url"), ((F.size(segments) > 0) | has(path, DETAIL_URL)).alias("entity_url"),
    )


def rules() -> dict[str, list[list[tuple[str, float, Column]]]]:
    """Routes of each page type: (signal, weight, condition) in order; a negative weight takes away, never below 0."""
    c = F.col
    few, paging = c("fields") <= 3, c("pager") | c("rel_pager") | (c("has_next") & (c("has_prev") | (c("numbered") >= 2) | c("next_link")))
    ratio = F.when(c("fields") > 0, c("fields") / (c("fields") + c("text_blocks"))).otherwise(0.0)
    filters = c("choices") + c("filter").cast("int")
    tall = F.coalesce("tall_area", F.lit(-1.0))
    dominates = (tall >= 0) & (c("page_area") > 0) & ((tall >= MIN_AREA * c("page_area")) | (c("held") >= MIN_SHARE * F.greatest("content", F.lit(1))))
    return {
        "login": [
            [("password_input", 0.45, c("passwords") == 1), ("submit_control", 0.20, c("submits")), ("few_fields", 0.10, few & (c("fields") > 0)), ("login_cue", 0.25, c("login_url") | c("login_said")), ("signup_cue", -0.40, c("signup_url") | c("signup_said"))],
            [("oauth_redirect_url", 0.60, c("oauth_url")), ("sso_buttons", 0.25, c("sso")), ("few_fields", 0.15, few)],
            [("sso_with_signin_cue", 0.85, c("sso") & (c("login_url") | c("login_headed"))), ("few_fields", 0.15, few)],
        ],
        "dashboard": [[("kpi_widgets", 0.30, c("kpis") >= 3), ("chart", 0.15, c("charts") == 1), ("charts", 0.35, c("charts") >= 2), ("minimal_inputs", 0.15, few), ("dashboard_cue", 0.15, c("dashboard_url") | c("dashboard_headed"))]],
        "list": [[("repeating_rows", 0.45, c("rows") >= MIN_ROWS), ("some_repeating_rows", 0.25, (c("rows") >= 3) & (c("rows") < MIN_ROWS)), ("pagination", 0.35, paging), ("table_header", 0.10, c("ths") >= 2), ("few_fields", 0.10, few)]],
        "detail": [[("single_heading", 0.15, c("h1s") == 1), ("read_only", 0.10, c("editable") <= 1), ("text_content", 0.10, c("text_blocks") >= 3), ("not_repeating", 0.10, c("rows") < MIN_ROWS), ("key_value_pairs", 0.30, (c("dts") >= 2) | (c("key_values") >= 2) | (c("readonly") >= 2)), ("entity_url", 0.25, c("entity_url"))]],
        "form": [[("many_fields", 0.25, c("fields") >= 3), ("high_input_to_text_ratio", 0.25, ratio >= MIN_FORM_RATIO), ("submit_control", 0.20, c("submits")), ("form_element", 0.10, c("form")), ("not_credentials_only", 0.20, ~((c("passwords") > 0) & few)), ("low_input_to_text_ratio", -0.30, ratio < MIN_FORM_RATIO)]],
        "search": [[("search_input", 0.30, c("search_input")), ("filter_controls", 0.25, filters >= 2), ("results_area", 0.30, c("results")), ("search_url", 0.15, c("search_url")), ("no_results_evidence", -0.30, ~(c("results") | c("search_url")))]],
        "checkout": [[("payment_fields", 0.50, c("payment_fields") >= 2), ("some_payment_field", 0.25, c("payment_fields") == 1), ("multi_step_indicator", 0.25, c("steps")), ("checkout_cue", 0.15, c("checkout_url") | c("checkout_said")), ("submit_control", 0.10, c("submits"))]],
        "nav_shell": [[("mostly_links", 0.40, (c("nav_links") >= 5) & (c("nav_links") / F.greatest(c("fields") + c("buttons") + c("nav_links"), F.lit(1)) >= 0.8)), ("navigation_landmark", 0.20, c("navs")), ("low_input_density", 0.20, c("fields") <= 1), ("little_prose", 0.20, c("nav_links") >= 2 * F.greatest("text_blocks", F.lit(1))), ("repeating_content_rows", -0.30, c("rows") >= MIN_ROWS)]],
        "modal": [[("dialog_or_overlay", 0.40, c("container")), ("dominates_page", 0.60, dominates)]],
    }


def _route(signals: list[tuple[str, float, Column]]) -> Column:
    total = F.lit(0.0)
    for _, weight, fires in signals:
        total = F.when(fires, F.greatest(F.lit(0.0), total + F.lit(weight))).otherwise(total)
    fired = F.filter(F.array(*(F.when(fires, ("-" if weight < 0 else "") + name) for name, weight, fires in signals)), lambda x: x.isNotNull())
    return F.struct(total.alias("total"), fired.alias("fired"))


def classify(elements: DataFrame) -> DataFrame:
    """(page_id, page_type, confidence, scores, signals). The first type in priority within a margin of the best wins."""
    f, made = features(elements), {}
    for kind, routes in rules().items():
        for i, route in enumerate(routes):
            f = f.withColumn(f"_{kind}{i}", _route(route))
        best = F.col(f"_{kind}0")
        for i in range(1, len(routes)):
            best = F.when(F.col(f"_{kind}{i}.total") > best["total"], F.col(f"_{kind}{i}")).otherwise(best)
        f = f.withColumn(f"_{kind}", best)
        made[kind] = F.round(F.least(F.col(f"_{kind}.total"), F.lit(1.0)), 2)
    f = f.select("page_id", *(s.alias(f"s_{k}") for k, s in made.items()), *(F.col(f"_{k}.fired").alias(f"f_{k}") for k in made))
    best = F.greatest(*(F.col(f"s_{k}") for k in PAGE_TYPES))
    choice = F.coalesce(*(F.when((best >= MIN_SCORE) & (F.col(f"s_{k}") >= MIN_SCORE) & (F.col(f"s_{k}") >= best - TIE_MARGIN - 1e-9), k) for k in PRIORITY), F.lit("unknown"))
    scores = F.create_map(*(x for k in PAGE_TYPES for x in (F.lit(k), F.col(f"s_{k}"))))
    signals = F.map_filter(F.create_map(*(x for k in PAGE_TYPES for x in (F.lit(k), F.col(f"f_{k}")))), lambda k, v: F.size(v) > 0)
    out = f.select("page_id", choice.alias("page_type"), scores.alias("scores"), signals.alias("signals"))
    return out.withColumn("confidence", F.coalesce(F.try_element_at("scores", column("page_type")), F.lit(0.0)))
