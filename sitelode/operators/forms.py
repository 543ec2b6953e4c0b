"""Login forms, second factors, login errors, and what to click: page-wise choices over element rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed, words
from .classify import SSO_BUTTON, has
from .elements import ancestors
from .roles import attribute, enabled, has_attribute, lowered, visible

# What must be equal for equal results.
TEXT_TYPES = ("", "text", "email", "tel")
USERNAME_HINT = r"user(name)?|e-?mail|login|identifier|account|phone|\bid\b"
NOT_A_USERNAME = r"search|\bq\b|query|captcha|coupon|promo|newsletter"
LOGIN_SUBMIT = r"\b(sign ?in|log ?in|continue|next|submit|go|enter)\b"
OTP_INPUT = r"one-time-code|\botp\b|totp|\bmfa\b|\b2fa\b|two[-_ ]?factor|verification[-_ ]?code|security[-_ ]?code|authenticator|passcode|one[-_ ]?time|sms[-_ ]?code"
MFA_TEXT = r"two[- ]factor|2[- ]step|two[- ]step|verification code|enter (the|your) (6-digit )?code|authenticator app|one[- ]time (code|password)|check your (phone|email)|we (sent|texted|emailed) (you )?a code"
ERROR_TEXT = (
    r"(invalid|incorrect|wrong|unknown) (user ?name|password|credentials|e-?mail|login)|(login|sign[- ]?in|authentication) (failed|error|unsuccessful)|"
    r"(couldn't|could not|can't|cannot) (find|sign|log)|not recognized|doesn't match|does not match|try again|account (is )?locked|too many (failed )?(attempts|tries)|access denied|unable to (sign|log)"
)
DENY_WORDS = (
    "delet", "remov", "destr", "eras", "discard", "purg", "wipe", "archiv", "trash", "pay", "purchas", "buy", "checkout", "check out", "donat", "upgrad",
    "place order", "order now", "complete order", "book now", "add to cart", "add to bag", "add to basket",
    "sign out", "signout", "sign off", "log out", "logout", "log off", "logoff", "submit", "send", "save", "confirm", "approv", "reject", "declin", "accept", "agree", "apply",
    "publish", "transfer", "withdraw", "invit", "cancel", "unsubscrib", "subscrib", "deactivat", "terminat", "revok", "reset", "clear", "disabl", "danger", "destructiv",
)
WHOLE_WORDS = ("ban", "block", "kick")
CLICK_ROLES = ("button", "link", "tab", "menuitem")
LABEL_ATTRIBUTES = ("aria-label", "title", "value", "alt", "name", "data-testid", "data-test")


def _usable(elements: DataFrame) -> DataFrame:
    t = lowered("type")
    parts = (F.nullif("id", F.lit("")), F.nullif("name", F.lit("")), F.nullif(F.array_join("classes", " "), F.lit("")), *(attribute(a) for a in ("placeholder", "aria-label", "autocomplete", "title", "data-testid")))
    own = F.coalesce("text_content", F.lit(""))
    text = F.when((own == "") & (F.col("tag") == "input") & t.isin("submit", "button", "image"), F.coalesce(F.col("attributes")["value"], F.lit(""))).otherwise(own)
    frame = F.array_join("iframe_path", "\x01")
    return elements.where(visible() & enabled()).select(
        "page_id", "doc_idx", "tag", t.alias("type"), F.lower(F.concat_ws(" ", *parts)).alias("blob"), squeezed(text).alias("text"), frame.alias("frame"), F.coalesce("css_selector", F.lit("")).alias("sel"), (F.coalesce(F.col("attributes")["role"], F.lit("")) == "button").alias("as_button")
    )


def login_forms(elements: DataFrame) -> DataFrame:
    """(page_id, password, username, submit, sso, action): document positions of the login controls of each page.

    A password only where a page has exactly one; then the innermost form around it bounds the search, a username
    stands before it, and a submit control preferably after it.
    """
    e, c, page = _usable(elements), F.col, Window.partitionBy("page_id")
    sso = (c("tag").isin("button", "a") | c("as_button")) & (has(c("text"), SSO_BUTTON) | has(c("blob"), SSO_BUTTON))
    is_pw = (c("tag") == "input") & (c("type") == "password")
    one = F.when(F.count_if(is_pw).over(page) == 1, F.max(F.when(is_pw, F.struct("doc_idx", "frame", "sel"))).over(page))
    e = e.withColumn("_sso", sso).withColumn("pw", one).withColumn("_form", (c("tag") == "form") & (c("sel") != ""))
    around = c("_form") & (c("frame") == c("pw.frame")) & F.startswith(c("pw.sel"), F.concat(c("sel"), F.lit(" ")))
    e = e.withColumn("_box", F.max(F.when(around, F.struct(F.length("sel").alias("n"), (-c("doc_idx")).alias("d"), c("sel").alias("sel")))).over(page))
    inside = c("_box").isNull() | F.startswith(c("sel"), F.concat(c("_box.sel"), F.lit(" ")))
    e = e.withColumn("_in", c("pw").isNull() | ((c("frame") == c("pw.frame")) & inside))
    user = c("_in") & (c("tag") == "input") & c("type").isin(*TEXT_TYPES) & ~has(c("blob"), NOT_A_USERNAME) & (c("pw").isNull() | (c("doc_idx") < c("pw.doc_idx")))
    send = c("_in") & (((c("tag") == "input") & c("type").isin("submit", "image")) | ((c("tag") == "button") & ((c("type") == "submit") | ((c("type") == "") & has(c("text"), LOGIN_SUBMIT)))))
    e = e.withColumn("_user", user).withColumn("_send", send).withColumn("_after", send & (c("doc_idx") > c("pw.doc_idx")))
    e = e.withColumn("_any_after", F.coalesce(F.bool_or("_after").over(page), F.lit(False))).withColumn("_pick", c("_send") & (F.coalesce("_after", F.lit(False)) | ~c("_any_after")))
    rows = e.groupBy("page_id").agg(
        F.first("pw.doc_idx").alias("password"), F.max(F.when(c("_user") & has(c("blob"), USERNAME_HINT), c("doc_idx"))).alias("_hinted"), F.max(F.when(c("_user"), c("doc_idx"))).alias("_plain"),
        F.min(F.when(c("_pick") & has(c("text"), LOGIN_SUBMIT), c("doc_idx"))).alias("_labelled"), F.min(F.when(c("_pick"), c("doc_idx"))).alias("_first"), F.array_sort(F.collect_list(F.when(c("_sso"), c("doc_idx")))).alias("sso"),
    )
    rows = rows.select("page_id", "password", F.coalesce("_hinted", "_plain").alias("username"), F.coalesce("_labelled", "_first").alias("submit"), "sso")
    action = F.when(c("password").isNotNull(), "password").when(c("username").isNotNull() & c("submit").isNotNull(), "identifier").when(F.size("sso") > 0, "sso").otherwise("none")
    return rows.withColumn("action", action)


def login_states(elements: DataFrame) -> DataFrame:
    """(page_id, mfa, error): whether a page asks for a second factor, and whether it says that a login went wrong."""
    e, c = _usable(elements), F.col
    entry = (c("tag") == "input") & c("type").isin("", "text", "tel", "number", "password")
    rows = e.groupBy("page_id").agg(
        F.bool_or(entry & has(c("blob"), OTP_INPUT)).alias("_otp"), F.bool_or((c("text") != "") & has(c("text"), MFA_TEXT)).alias("_said"), F.bool_or(entry & (c("type") != "password")).alias("_typed"),
        F.bool_or((c("text") != "") & (F.length("text") < 250) & has(c("text"), ERROR_TEXT)).alias("error"),
    )
    return rows.select("page_id", (c("_otp") | (c("_said") & c("_typed"))).alias("mfa"), "error")


def page_signature(elements: DataFrame) -> DataFrame:
    """(page_id, signature): changes when the URL or any visible text does."""
    shown = elements.where(visible()).groupBy("page_id", "page_url").agg(F.array_sort(F.collect_list(F.coalesce("text_content", F.lit("")))).alias("t"))
    return shown.select("page_id", F.sha1(F.concat_ws("\n", F.col("page_url"), F.array_join("t", "\n"))).alias("signature"))


def deny_pattern(extra: tuple[str, ...] = ()) -> str:
    import re

    starts = "|".join(re.escape(w).replace("\\ ", " ") for w in (*DENY_WORDS, *extra))
    return rf"(?<![a-z0-9])(?:{starts})|(?<![a-z0-9])(?:{'|'.join(WHOLE_WORDS)})(?![a-z0-9])"


def click_candidates(elements: DataFrame, limit: int = 15, extra_deny: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """((page_id, doc_idx, label), (page_id, candidates, skipped_unsafe, over_limit)).

    An element's descendants are the run of elements right after it that are inside it; their texts are its label.
    """
    c = F.col
    frame, sel, t = F.array_join("iframe_path", "\x01"), F.coalesce("css_selector", F.lit("")), lowered("type")
    attrs = F.array(*(F.btrim(F.coalesce(F.col("attributes")[a], F.lit(""))) for a in LABEL_ATTRIBUTES))
    href = F.lower(F.btrim(F.coalesce(F.col("attributes")["href"], F.lit(""))))
    clickable = F.when(c("tag").isin("html", "body", "form", "head") | ~F.coalesce("computed.visible", F.lit(False)) | ~enabled() | (sel == ""), False).when(c("tag") == "button", True).when(c("tag") == "input", t == "button").when(c("tag") == "a", href.isin("", "#") | F.startswith(href, F.lit("javascript:"))).otherwise(lowered("role").isin(*CLICK_ROLES) | has_attribute("onclick"))
    path = F.col("dom_context.tag_path")
    in_form = F.coalesce(F.array_contains(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), "form"), F.lit(False))
    commits = has_attribute("formaction") | has_attribute("download") | ((c("tag") == "input") & t.isin("submit", "image", "reset")) | ((c("tag") == "button") & in_form & t.isin("", "submit", "reset"))
    own_signals = F.concat(F.array(F.coalesce("id", F.lit("")), F.array_join("classes", " ")), attrs, F.array(F.coalesce(F.col("attributes")["href"], F.lit("")), F.coalesce(F.col("attributes")["onclick"], F.lit(""))))
    below = F.array(F.coalesce("id", F.lit("")), F.array_join("classes", " "), F.coalesce(F.col("attributes")["aria-label"], F.lit("")), F.coalesce(F.col("attributes")["title"], F.lit("")))
    key = F.concat(frame, F.lit("\x02"), sel)
    e = elements.select(
        "page_id", "doc_idx", "tag", frame.alias("frame"), key.alias("key"), F.transform(ancestors(sel), lambda a: F.concat(frame, F.lit("\x02"), a)).alias("up"), clickable.alias("clickable"), commits.alias("commits"),
        F.coalesce("text_content", F.lit("")).alias("text"), attrs.alias("attrs"), own_signals.alias("signals"), below.alias("below"), F.coalesce("id", F.lit("")).alias("id"), F.array_join("classes", " ").alias("classes"), F.col("attributes")["role"].alias("role"),
    )
    mine = e.where("clickable").select("page_id", F.col("doc_idx").alias("at"), F.col("key").alias("_key"))
    inner = e.select("page_id", "doc_idx", "text", "below", F.explode("up").alias("_key")).join(mine, ["page_id", "_key"]).where(c("doc_idx") > c("at"))
    run = inner.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "at").orderBy("doc_idx"))).where(c("doc_idx") == c("at") + c("_n"))
    under = run.groupBy("page_id", "at").agg(F.array_sort(F.collect_list(F.struct("doc_idx", "text", "below"))).alias("d"))
    under = under.withColumnRenamed("at", "doc_idx")
    e = e.where("clickable").join(under, ["page_id", "doc_idx"], "left")
    texts = F.filter(F.concat(F.array("text"), F.coalesce(F.transform("d", lambda x: x["text"]), F.array().cast("array<string>"))), lambda x: x != "")
    said = F.btrim(F.array_join(texts, " "))
    label = F.when(said != "", F.substring(said, 1, 60)).otherwise(F.coalesce(F.substring(F.try_element_at(F.filter("attrs", lambda a: a != ""), F.lit(1)), 1, 60), c("id")))
    pieces = F.concat(F.array(label), c("signals"), F.coalesce(F.flatten(F.transform("d", lambda x: x["below"])), F.array().cast("array<string>")))
    unsafe = c("commits") | F.array_join(F.transform(F.filter(pieces, lambda p: p != ""), lambda p: words(p)), " ").rlike(deny_pattern(extra_deny))
    e = e.select("page_id", "doc_idx", "frame", "tag", "role", "classes", label.alias("label"), unsafe.alias("unsafe"))
    same = F.when(words("label") != "", words("label")).otherwise(F.concat(F.lit("class:"), c("classes")))
    first = F.row_number().over(Window.partitionBy("page_id", "unsafe", "frame", "tag", F.coalesce("role", F.lit("\x01")), same).orderBy("doc_idx"))
    e = e.withColumn("_first", first).where("unsafe or _first = 1").withColumn("_nth", F.row_number().over(Window.partitionBy("page_id", "unsafe").orderBy("doc_idx")))
    totals = e.groupBy("page_id").agg(F.count_if(~c("unsafe") & (c("_nth") <= limit)).alias("candidates"), F.count_if(c("unsafe")).alias("skipped_unsafe"), F.count_if(~c("unsafe") & (c("_nth") > limit)).alias("over_limit"))
    return e.where(~c("unsafe") & (c("_nth") <= limit)).select("page_id", "doc_idx", "label"), totals


def state(mfa: Column, login: Column, in_scope: Column) -> Column:
    """Where a login stands: second factor, still at a login, done, or on the way."""
    return F.when(mfa, "mfa").when(login, "login").when(in_scope, "done").otherwise("pending")
