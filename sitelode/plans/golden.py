"""Queries over small pages and tables of our own whose answers are known, each with the answer as SQL.

The driver's captured pages have no forms, ids, controls or frames. These have, so that the operators that need them are
held against stated rows too. The stated rows were printed by the operators first, then
checked by hand against their rules, row by row: they guard against change, and prove as much as that reading did.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import access, classify, discovery, elements, forms, healing, roles, rolediff, scripts
from ..scratch import kept
from ..sources import html
from ..streaming import outbox

PAGES = [
    (1, "https://x.org/login", '<html><body><form><label for="u">User</label><input id="u" name="user"><input type="password" value="s3cret"><button type="submit">Sign in</button></form><a href="/sso">Continue with Google</a></body></html>'),
    (2, "https://x.org/orders", "<html><body><h1>Orders</h1><table>" + "".join(f'<tr class="row"><td>{i}</td><td>x{i}</td></tr>' for i in range(6)) + '</table><a rel="next" href="?page=2">Next</a></body></html>'),
    (3, "https://x.org/", "<html><body><nav><ul>" + "".join(f'<li><a href="/s{i}.html">S {i}</a>' for i in range(8)) + "</ul></nav></body></html>"),
    (4, "https://x.org/search?q=a", '<html><body><form><input type="search" name="q"><select><option>a</select><input type="checkbox"></form><div class="search-results"><p>hit</div></body></html>'),
    (5, "https://x.org/contact", '<html><body><form><input name="first"><input name="last"><textarea name="message"></textarea><button type="submit">Send</button></form></body></html>'),
    (6, "https://x.org/checkout", '<html><body><form><input name="cardnumber" autocomplete="cc-number"><input name="cvc"><button>Pay now</button></form><ol class="stepper"><li>Pay</ol></body></html>'),
    (7, "https://x.org/otp", '<html><body><p>Enter your code</p><input name="otp" autocomplete="one-time-code"><div>Invalid password, try again</div></body></html>'),
    (8, "https://x.org/app", '<html><body><button>Show <i>more</i></button><button>Delete</button><div onclick="go()">Tab</div><form><button>Go</button></form><button>Show more</button><a href="#">Menu</a></body></html>'),
]


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def page_elements(spark: SparkSession) -> DataFrame:
    return elements.with_ids(html.elements(pages(spark)))


IDS = ["user-4471", "login-form", "a1:b22:333", "row-0a1b2c3d-1111-4222-8333-444455556666", "btn_a3f9c2d81b", "item-20250101", "", None]


def golden_ids(spark, sf_dir):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(IDS)], "n long, v string")
    return rows.select("n", U.normalize_id("v").alias("normal"))


URLS = [
    "HTTPS://Shop.EXAMPLE:443/a/b/", "http://shop.example:80", "http://shop.example:8080/x", "https://s.example/p?b=2&a=1", "https://s.example/p?utm_source=x&id=7&gclid=z&PHPSESSID=q", "https://s.example/p;jsessionid=AB1?x=1",
    "https://s.example/p#part", "https://s.example/app#/orders/5", "https://me:pw@s.example/p?k=v#f", "http://s.example:notaport/", "https://login.s.example/oauth2/authorize?client_id=3", "mailto:a@b.c", "https://s.example/file.PDF", "https://www.s.example/orders/123/", None,
]


def golden_urls(spark, sf_dir):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(URLS)], "n long, v string")
    return rows.select(
        "n", U.normalize_url("v").alias("normal"), U.template_key("v").alias("template"), F.coalesce(U.is_page_url("v"), F.lit(False)).alias("page"), U.host_key("v").alias("host"), U.origin("v").alias("origin"), U.redact_url("v").alias("redacted"), F.coalesce(U.is_oauth_url("v"), F.lit(False)).alias("oauth"), F.coalesce(U.same_page("v", F.lit("https://s.example/p")), F.lit(False)).alias("same")
    )


STORES = ["postgresql://me:secret@db:5432/x", "postgresql://me@db/x", "/data/store.db"]
FRAME_URLS = ["https://A.example/x", "about:blank", "", "file:///tmp/a.html"]


def golden_masks(spark, sf_dir):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(STORES + FRAME_URLS)], "n long, v string")
    return rows.select("n", F.when(F.col("n") < len(STORES), U.mask_password("v")).otherwise(U.frame_origin("v")).alias("shown"), U.href_tail("v").alias("tail"))


PAGERS = ["next", "next »", "next page", "›", "« previous", "‹", "older", "newer", "nextel", "2", ""]
NAMES = ["Sign in / Log In!", "userName2Go", "  Ärger & Söhne  ", ""]


def golden_text(spark, sf_dir):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(PAGERS + NAMES)], "n long, v string")
    return rows.select("n", T.page_direction("v").alias("way"), T.slug("v").alias("slug"), T.words("v").alias("words"), scripts.snake(F.col("v")).alias("snake"), scripts.pascal(F.col("v")).alias("pascal"))


def golden_paths(spark, sf_dir):
    rows = spark.createDataFrame([(1, '//*[@id="u"]/div[2]/input'), (2, "/html/body/div[1]/a"), (3, "")], "n long, v string")
    at = F.to_timestamp(F.lit("2026-01-02 03:04:05.678"))
    return rows.select("n", F.array_join(T.xpath_tags("v"), ">").alias("tags"), T.iso_utc(at).alias("at"))


SIMILAR = [("Sign in", " sign  IN "), ("abcdef", "uvwxyz"), ("abcd", "abcf"), ("Save", None)]


def golden_similarity(spark, sf_dir):
    """abcd and abcf share 3 of 4: the ratio 0.75 is stretched to 0.5."""
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(SIMILAR)], "n long, a string, b string")
    return rows.select("n", F.round(T.text_similarity("a", "b"), 6).alias("similarity"))


def golden_elements(spark, sf_dir):
    e = page_elements(spark).where("page_id = 1")
    return e.select("doc_idx", "tag", "id", "name", "text_content", "css_selector", "xpath", F.array_join("dom_context.tag_path", ">").alias("tag_path"), F.col("dom_context.nearby_label_text").alias("label"), F.col("computed.href").alias("href"), F.col("attributes")["value"].alias("value"))


def golden_roles(spark, sf_dir):
    e = roles.assign_roles(page_elements(spark).where("page_id in (1, 4, 5, 8)"))
    return e.select("page_id", "doc_idx", "role")


def golden_counts(spark, sf_dir):
    c = elements.element_counts(page_elements(spark))
    return c.select("page_id", "total", "visible", F.coalesce(F.col("by_tag")["input"], F.lit(0).cast("long")).alias("inputs"), F.col("by_frame")["main"].alias("main"))


def golden_types(spark, sf_dir):
    return classify.classify(kept(page_elements(spark).where("page_id <= 6"))).select("page_id", "page_type")


def golden_login(spark, sf_dir):
    e = page_elements(spark)
    place = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    f = forms.login_forms(e).select("page_id", place("password"), place("username"), place("submit"), F.size("sso").alias("n_sso"), "action")
    s = forms.login_states(e)
    both = f.join(s, "page_id")
    return both.withColumn("state", forms.state(F.col("mfa"), F.col("action") != "none", F.lit(True)))


def golden_clicks(spark, sf_dir):
    return forms.click_candidates(page_elements(spark).where("page_id = 8"), limit=2)[0]


def golden_click_totals(spark, sf_dir):
    return forms.click_candidates(page_elements(spark).where("page_id = 8"), limit=2)[1]


def golden_specs(spark, sf_dir):
    e = kept(page_elements(spark).where("page_id in (1, 3)"))
    s = scripts.page_specs(e, classify.classify(e))
    return s.select("page_id", "class_name", "function_name", F.array_join(F.transform("elements", lambda x: x["method"]), ",").alias("methods"), F.array_join(F.transform("steps", lambda x: F.concat_ws(" ", x["action"], x["role"], x["value"])), ", ").alias("steps"))


def _moved(e: DataFrame) -> DataFrame:
    """The login page with ids and places gone, all else as it was."""
    e = e.withColumn("id", F.when(F.col("tag") != "input", F.col("id"))).withColumn("id_normalized", F.lit(None).cast("string"))
    return e.withColumn("css_selector", F.concat("css_selector", F.lit(" > x"))).withColumn("xpath", F.concat("xpath", F.lit("/x")))


def golden_heal(spark, sf_dir):
    """Fingerprints of the login page against itself, against one without ids and places, and against another page."""
    all_ = kept(page_elements(spark))
    e = all_.where("page_id = 1")
    at = lambda rows, how: rows.withColumn("page_url", F.lit(how))
    later = at(e, "same").unionByName(at(_moved(e), "ids")).unionByName(at(all_.where("page_id = 2"), "other"))
    store = healing.fingerprints(e)
    stores = at(store, "same").unionByName(at(store, "ids")).unionByName(at(store, "other"))
    return healing.resolve(kept(stores), kept(later)).select(F.col("page_url").alias("later"), "element_role", "outcome", "kind", "strategy", "reason")


def golden_changes(spark, sf_dir):
    """What a changed text, a changed class and a changed type mean."""
    old = healing.fingerprints(page_elements(spark).where("page_id = 1")).where("element_role = 'button:sign-in'")
    pair = old.select(F.struct(*healing.FIELDS).alias("old"), F.struct(*healing.FIELDS).alias("new"))
    new = F.col("new")
    variants = (("text", new.withField("text_content", F.lit("Delete all"))), ("class", new.withField("classes", F.array(F.lit("wide")))), ("type", new.withField("attributes", F.create_map(F.lit("type"), F.lit("button")))), ("none", new))
    out = None
    for what, changed in variants:
        one = healing.changes(pair.withColumn("new", changed)).select(F.lit(what).alias("what"), F.array_join("changed_fields", ",").alias("changed"), "change_kind")
        out = one if out is None else out.unionByName(one)
    return out


FRAMES = [
    (1, "t", None, 0, None, "https://a.example/", True), (1, "p", "t", 0, "panel", "https://a.example/p", True), (1, "q", "t", 1, "panel", "about:blank", True), (1, "f", "t", 2, "ad", "https://b.example/", True),
    (1, "g", "f", 0, None, "https://a.example/in", True), (1, "u", "t", 3, None, "https://a.example/u", False),
]


def golden_frames(spark, sf_dir):
    f = spark.createDataFrame(FRAMES, "page_id long, frame_id string, parent_id string, pos int, name string, url string, readable boolean")
    return elements.frame_tree(f).select("frame_id", F.array_join("path", "/").alias("path"), "skip_reason")


GRAPH = [("http://h/a", i, f"http://h/p/{i}") for i in range(6)] + [("http://h/a", 9, "http://h/b"), ("http://h/b", 0, "http://h/c"), ("http://h/p/0", 0, "http://h/a")]


def golden_frontier(spark, sf_dir):
    """Breadth first; after two pages of a template the rest of it waits until nothing else is left."""
    e = spark.createDataFrame(GRAPH, "src string, pos int, dst string")
    return discovery.frontier(e, ["http://h/a"], max_pages=20, template_sample=2)[0].select(F.col("visit_seq").cast("long").alias("visit_seq"), "url")


VISITS = [(1, "u1", "h", "list", "pending"), (2, "u2", "h", "form", "extracted"), (3, "u1", "z", "x", "pending"), (4, "u3", None, "x", "failed"), (5, "u4", None, "x", "failed")]


def golden_manifest(spark, sf_dir):
    v = spark.createDataFrame(VISITS, "visit_seq long, url string, structural_hash string, page_type string, status string")
    m = discovery.mark(discovery.manifest(v), spark.createDataFrame([("u1", "extracted")], "url string, status string"))
    return m.select("url", F.array_join("variant_urls", ",").alias("variants"), "page_type", "status")


def golden_manifest_counts(spark, sf_dir):
    v = spark.createDataFrame(VISITS, "visit_seq long, url string, structural_hash string, page_type string, status string")
    c = discovery.counts(discovery.manifest(v))
    return c.select(*(F.col(x).cast("long").alias(x) for x in c.columns if x in ("pages_extracted", "pages_failed")))


def golden_roles_compared(spark, sf_dir):
    p = spark.createDataFrame([("admin", "u", "extracted", ["v"]), ("admin", "w", "failed", []), ("guest", "u", "extracted", [])], "role string, url string, status string, variant_urls array<string>")
    r = rolediff.reached(p)
    names = spark.createDataFrame([("admin", "u", "a"), ("guest", "u", "a"), ("admin", "u", "b"), ("admin", "x", "c")], "role string, url string, element string")
    pd, ed = rolediff.page_differences(r, ["admin", "guest"]), rolediff.element_differences(names, names.select("role", "url").distinct(), ["admin", "guest"])
    return rolediff.summary(r, pd, ed, ["admin", "guest"])


def golden_delivery(spark, sf_dir):
    """The third delivery's retries run out, so nothing after it is tried."""
    box = spark.createDataFrame([(i, f"d{i}", "pending", 0, None) for i in range(1, 6)], "seq long, delivery_id string, status string, attempts int, last_error string")
    log = spark.createDataFrame([("d1", 1, 500), ("d1", 2, 200), ("d2", 1, 400), ("d3", 1, 500), ("d3", 2, None), ("d3", 3, 503), ("d4", 1, 200)], "delivery_id string, n int, status int")
    return outbox.deliver(box, log).select("delivery_id", "status", F.col("attempts").cast("long").alias("attempts"), "last_error")


def golden_payload(spark, sf_dir):
    e = spark.createDataFrame([("page_discovered", "r1", {"url": "u"}, None), ("page_discovered", "r1", {"url": "u"}, "admin")], "event string, run_id string, data map<string,string>, role string")
    return e.withColumn("ts", F.to_timestamp(F.lit("2026-01-02 03:04:05"))).select(outbox.payload().alias("payload"))


def golden_signatures(spark, sf_dir):
    """Published test vectors of HMAC-SHA256: a short key, and one longer than a block."""
    e = spark.createDataFrame([("what do ya want for nothing?", "Test Using Larger Than Block-Size Key - Hash Key First")], "a string, b string")
    return e.select(outbox.signature("Jefe", "a").alias("short"), outbox.signature(b"\xaa" * 131, "b").alias("long"))


ROLES = ["admin", "read-only", "read_only", "admin", "Admin", "pages", "9lives", None, "guest", "a" * 33]


def golden_role_names(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(ROLES)), "n long, role string")
    return access.role_faults(rows).select("n", "fault", access.credential_names("role", "APP_USER", "APP_PASSWORD")["password"].alias("variable"))


def golden_trusted(spark, sf_dir):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(["https://www.s.example/login", "https://s.example.evil.net/login", "https://login.other.net/oauth2/authorize?client_id=3", "http://s.example:8080/login", None])], "n long, url string")
    return access.trusted_targets(rows, spark.createDataFrame([("https://s.example/",)], "url string")).select("n", "trusted")


def golden_coverage(spark, sf_dir):
    store = healing.fingerprints(page_elements(spark).where("page_id in (1, 5)"))
    return healing.coverage(pages(spark).where("page_id in (1, 2, 5)"), store)


def golden_explained(spark, sf_dir):
    """Signals of a button against itself."""
    old = healing.fingerprints(page_elements(spark).where("page_id = 1")).where("element_role = 'button:sign-in'")
    pair = healing.scored(old.select(F.struct(*healing.FIELDS).alias("old"), F.struct(*healing.FIELDS).alias("new")))
    return pair.select(F.explode(healing.explained()).alias("signal", "similarity"))


FOUND = (
    golden_ids, golden_urls, golden_masks, golden_text, golden_paths, golden_similarity, golden_elements, golden_roles, golden_counts, golden_types, golden_login, golden_clicks, golden_click_totals, golden_specs, golden_heal,
    golden_changes, golden_frames, golden_frontier, golden_manifest, golden_manifest_counts, golden_roles_compared, golden_delivery, golden_payload,
    golden_signatures, golden_role_names, golden_trusted, golden_coverage, golden_explained,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in FOUND}


def _rows(columns: str, *rows: str) -> str:
    """SELECT of stated rows; columns as name type."""
    named = [c.split() for c in columns.split(", ")]
    casts = ", ".join(f'CAST({n}_ AS {t}) AS "{n}"' for n, t in named)
    return f"SELECT {casts} FROM (VALUES {', '.join(rows)}) t({', '.join(n + '_' for n, _ in named)})"


SQL: dict[str, str] = {
    "golden_ids": _rows(
        "n BIGINT, normal VARCHAR",
        "(0, 'user-{n}')",
        "(1, 'login-form')",
        "(2, 'a{n}:b{n}:{n}')",
        "(3, 'row-{uuid}')",
        "(4, 'btn_{hex}')",
        "(5, 'item-{n}')",
        '(6, NULL)',
        '(7, NULL)',
    ),
    "golden_urls": _rows(
        "n BIGINT, normal VARCHAR, template VARCHAR, page BOOLEAN, host VARCHAR, origin VARCHAR, redacted VARCHAR, oauth BOOLEAN, same BOOLEAN",
        "(0, 'https://shop.example/a/b', 'https://shop.example/a/b', TRUE, 'shop.example', 'https://Shop.EXAMPLE:443', 'https://Shop.EXAMPLE:443/a/b/', FALSE, FALSE)",
        "(1, 'http://shop.example/', 'http://shop.example/', TRUE, 'shop.example', 'http://shop.example:80', 'http://shop.example:80', FALSE, FALSE)",
        "(2, 'http://shop.example:8080/x', 'http://shop.example:8080/x', TRUE, 'shop.example', 'http://shop.example:8080', 'http://shop.example:8080/x', FALSE, FALSE)",
        "(3, 'https://s.example/p?a=1&b=2', 'https://s.example/p?a=1&b=2', TRUE, 's.example', 'https://s.example', 'https://s.example/p', FALSE, FALSE)",
        "(4, 'https://s.example/p?id=7', 'https://s.example/p?id=7', TRUE, 's.example', 'https://s.example', 'https://s.example/p', FALSE, FALSE)",
        "(5, 'https://s.example/p?x=1', 'https://s.example/p?x=1', TRUE, 's.example', 'https://s.example', 'https://s.example/p;jsessionid=AB1', FALSE, FALSE)",
        "(6, 'https://s.example/p', 'https://s.example/p', TRUE, 's.example', 'https://s.example', 'https://s.example/p', FALSE, TRUE)",
        "(7, 'https://s.example/app#/orders/5', 'https://s.example/app#/orders/5', TRUE, 's.example', 'https://s.example', 'https://s.example/app', FALSE, FALSE)",
        "(8, 'https://s.example/p?k=v', 'https://s.example/p?k=v', TRUE, 's.example', 'https://me:pw@s.example', 'https://s.example/p', FALSE, FALSE)",
        "(9, NULL, NULL, TRUE, 's.example', 'http://s.example:notaport', 'http://s.example:notaport/', FALSE, FALSE)",
        "(10, 'https://login.s.example/oauth2/authorize?client_id=3', 'https://login.s.example/oauth{n}/authorize?client_id=3', TRUE, 'login.s.example', 'https://login.s.example', 'https://login.s.example/oauth2/authorize', TRUE, FALSE)",
        "(11, 'mailto:a@b.c', 'mailto:a@b.c', FALSE, '', 'mailto://', 'mailto:a@b.c', FALSE, FALSE)",
        "(12, 'https://s.example/file.PDF', 'https://s.example/file.PDF', FALSE, 's.example', 'https://s.example', 'https://s.example/file.PDF', FALSE, FALSE)",
        "(13, 'https://www.s.example/orders/123', 'https://www.s.example/orders/{n}', TRUE, 's.example', 'https://www.s.example', 'https://www.s.example/orders/123/', FALSE, FALSE)",
        "(14, NULL, NULL, FALSE, NULL, NULL, NULL, FALSE, FALSE)",
    ),
    "golden_masks": _rows(
        "n BIGINT, shown VARCHAR, tail VARCHAR",
        "(0, 'postgresql://me:***@db:5432/x', 'x')",
        "(1, 'postgresql://me@db/x', 'x')",
        "(2, '/data/store.db', 'store.db')",
        "(3, 'https://a.example', 'x')",
        "(4, NULL, 'about:blank')",
        '(5, NULL, NULL)',
        "(6, 'file://', 'a.html')",
    ),
    "golden_text": _rows(
        "n BIGINT, way VARCHAR, slug VARCHAR, words VARCHAR, snake VARCHAR, pascal VARCHAR",
        "(0, 'next', 'next', 'next', 'next', 'Next')",
        "(1, 'next', 'next', 'next', 'next', 'Next')",
        "(2, 'next', 'next-page', 'next page', 'next_page', 'NextPage')",
        "(3, 'next', '', '', 'element', '')",
        "(4, 'prev', 'previous', 'previous', 'previous', 'Previous')",
        "(5, 'prev', '', '', 'element', '')",
        "(6, 'next', 'older', 'older', 'older', 'Older')",
        "(7, 'prev', 'newer', 'newer', 'newer', 'Newer')",
        "(8, NULL, 'nextel', 'nextel', 'nextel', 'Nextel')",
        "(9, NULL, '2', '2', '_2', '2')",
        "(10, NULL, '', '', 'element', '')",
        "(11, NULL, 'sign-in-log-in', 'sign in log in', 'sign_in_log_in', 'SignInLogIn')",
        "(12, NULL, 'username2go', 'user name2 go', 'username2go', 'Username2go')",
        "(13, NULL, 'rger-s-hne', 'rger s hne', 'rger_s_hne', 'RgerSHne')",
        "(14, NULL, '', '', 'element', '')",
    ),
    "golden_paths": _rows(
        "n BIGINT, tags VARCHAR, at VARCHAR",
        "(1, 'div>input', '2026-01-02T03:04:05.678Z')",
        "(2, 'html>body>div>a', '2026-01-02T03:04:05.678Z')",
        "(3, '', '2026-01-02T03:04:05.678Z')",
    ),
    "golden_similarity": _rows(
        "n BIGINT, similarity DOUBLE",
        '(0, 1.0)',
        '(1, 0.0)',
        '(2, 0.5)',
        '(3, NULL)',
    ),
    "golden_elements": _rows(
        "doc_idx INTEGER, tag VARCHAR, id VARCHAR, name VARCHAR, text_content VARCHAR, css_selector VARCHAR, xpath VARCHAR, tag_path VARCHAR, label VARCHAR, href VARCHAR, value VARCHAR",
        "(0, 'html', NULL, NULL, NULL, 'html', '/html[1]', 'html', NULL, NULL, NULL)",
        "(1, 'body', NULL, NULL, NULL, 'html > body', '/html[1]/body[1]', 'html>body', NULL, NULL, NULL)",
        "(2, 'form', NULL, NULL, NULL, 'html > body > form', '/html[1]/body[1]/form[1]', 'html>body>form', NULL, NULL, NULL)",
        "(3, 'label', NULL, NULL, 'User', 'html > body > form > label', '/html[1]/body[1]/form[1]/label[1]', 'html>body>form>label', NULL, NULL, NULL)",
        '(4, \'input\', \'u\', \'user\', NULL, \'#u\', \'//*[@id="u"]\', \'html>body>form>input\', \'User\', NULL, NULL)',
        "(5, 'input', NULL, NULL, NULL, 'html > body > form > input:nth-of-type(2)', '/html[1]/body[1]/form[1]/input[2]', 'html>body>form>input', NULL, NULL, '[redacted]')",
        "(6, 'button', NULL, NULL, 'Sign in', 'html > body > form > button', '/html[1]/body[1]/form[1]/button[1]', 'html>body>form>button', NULL, NULL, NULL)",
        "(7, 'a', NULL, NULL, 'Continue with Google', 'html > body > a', '/html[1]/body[1]/a[1]', 'html>body>a', NULL, 'https://x.org/sso', NULL)",
    ),
    "golden_roles": _rows(
        "page_id BIGINT, doc_idx INTEGER, role VARCHAR",
        "(1, 4, 'textbox:user')",
        "(1, 5, 'textbox')",
        "(1, 6, 'button:sign-in')",
        "(1, 7, 'link:continue-with-google')",
        "(4, 3, 'searchbox:q')",
        "(4, 4, 'combobox')",
        "(4, 6, 'checkbox')",
        "(5, 3, 'textbox:first')",
        "(5, 4, 'textbox:last')",
        "(5, 5, 'textbox:message')",
        "(5, 6, 'button:send')",
        "(8, 2, 'button:show')",
        "(8, 4, 'button:delete')",
        "(8, 7, 'button:go')",
        "(8, 8, 'button:show-more')",
        "(8, 9, 'link:menu')",
    ),
    "golden_counts": _rows(
        "page_id BIGINT, total BIGINT, visible BIGINT, inputs BIGINT, main BIGINT",
        '(1, 8, 8, 2, 8)',
        '(2, 23, 23, 0, 23)',
        '(3, 20, 20, 0, 20)',
        '(4, 9, 9, 2, 9)',
        '(5, 7, 7, 2, 7)',
        '(6, 8, 8, 2, 8)',
        '(7, 5, 5, 1, 5)',
        '(8, 10, 10, 0, 10)',
    ),
    "golden_types": _rows(
        "page_id BIGINT, page_type VARCHAR",
        "(1, 'login')",
        "(2, 'list')",
        "(3, 'nav_shell')",
        "(4, 'search')",
        "(5, 'form')",
        "(6, 'checkout')",
    ),
    "golden_login": _rows(
        "page_id BIGINT, password INTEGER, username INTEGER, submit INTEGER, n_sso INTEGER, action VARCHAR, mfa BOOLEAN, error BOOLEAN, state VARCHAR",
        "(1, 5, -1, 6, 1, 'password', FALSE, FALSE, 'login')",
        "(2, -1, -1, -1, 0, 'none', FALSE, FALSE, 'done')",
        "(3, -1, -1, -1, 0, 'none', FALSE, FALSE, 'done')",
        "(4, -1, -1, -1, 0, 'none', FALSE, FALSE, 'done')",
        "(5, -1, 4, 6, 0, 'identifier', FALSE, FALSE, 'login')",
        "(6, -1, 4, -1, 0, 'none', FALSE, FALSE, 'done')",
        "(7, -1, 3, -1, 0, 'none', TRUE, TRUE, 'mfa')",
        "(8, -1, -1, 7, 0, 'none', FALSE, FALSE, 'done')",
    ),
    "golden_clicks": _rows(
        "page_id BIGINT, doc_idx INTEGER, label VARCHAR",
        "(8, 2, 'Show more')",
        "(8, 5, 'Tab')",
    ),
    "golden_click_totals": _rows(
        "page_id BIGINT, candidates BIGINT, skipped_unsafe BIGINT, over_limit BIGINT",
        '(8, 2, 2, 1)',
    ),
    "golden_specs": _rows(
        "page_id BIGINT, class_name VARCHAR, function_name VARCHAR, methods VARCHAR, steps VARCHAR",
        "(1, 'LoginPage', 'login', 'fill_user,fill_textbox,click_sign_in,click_continue_with_google', 'fill textbox:user {USERNAME}, fill textbox {PASSWORD}, click button:sign-in')",
        "(3, 'HomePage', 'home', 'click_s_0,click_s_1,click_s_2,click_s_3,click_s_4,click_s_5,click_s_6,click_s_7', '')",
    ),
    "golden_heal": _rows(
        "later VARCHAR, element_role VARCHAR, outcome VARCHAR, kind VARCHAR, strategy VARCHAR, reason VARCHAR",
        "('ids', 'button:sign-in', 'healed', 'fallback', 'text', NULL)",
        "('ids', 'link:continue-with-google', 'healed', 'fallback', 'text', NULL)",
        "('ids', 'textbox', 'failed', NULL, NULL, 'below_threshold')",
        "('ids', 'textbox:user', 'healed', 'fallback', 'name', NULL)",
        "('other', 'button:sign-in', 'failed', NULL, NULL, 'below_threshold')",
        "('other', 'link:continue-with-google', 'failed', NULL, NULL, 'below_threshold')",
        "('other', 'textbox', 'failed', NULL, NULL, 'below_threshold')",
        "('other', 'textbox:user', 'failed', NULL, NULL, 'below_threshold')",
        "('same', 'button:sign-in', 'exact', NULL, 'css', NULL)",
        "('same', 'link:continue-with-google', 'exact', NULL, 'css', NULL)",
        "('same', 'textbox', 'exact', NULL, 'css', NULL)",
        "('same', 'textbox:user', 'exact', NULL, 'id', NULL)",
    ),
    "golden_changes": _rows(
        "what VARCHAR, changed VARCHAR, change_kind VARCHAR",
        "('class', 'classes', 'churn')",
        "('none', '', 'churn')",
        "('text', 'text_content', 'regression')",
        "('type', 'attributes.type', 'regression')",
    ),
    "golden_frames": _rows(
        "frame_id VARCHAR, path VARCHAR, skip_reason VARCHAR",
        "('f', 'main/ad', 'cross_origin')",
        "('g', 'main/ad/frame0', 'inside_cross_origin_frame')",
        "('p', 'main/panel', NULL)",
        "('q', 'main/panel#2', NULL)",
        "('t', 'main', NULL)",
        "('u', 'main/frame3', 'unreadable')",
    ),
    "golden_frontier": _rows(
        "visit_seq BIGINT, url VARCHAR",
        "(0, 'http://h/a')",
        "(1, 'http://h/p/0')",
        "(2, 'http://h/p/1')",
        "(3, 'http://h/b')",
        "(4, 'http://h/c')",
        "(5, 'http://h/p/2')",
        "(6, 'http://h/p/3')",
        "(7, 'http://h/p/4')",
        "(8, 'http://h/p/5')",
    ),
    "golden_manifest": _rows(
        "url VARCHAR, variants VARCHAR, page_type VARCHAR, status VARCHAR",
        "('u1', 'u2', 'list', 'extracted')",
        "('u3', '', 'x', 'failed')",
        "('u4', '', 'x', 'failed')",
    ),
    "golden_manifest_counts": _rows(
        "pages_extracted BIGINT, pages_failed BIGINT",
        '(0, 2)',
    ),
    "golden_roles_compared": _rows(
        "role VARCHAR, pages_reached BIGINT, only_pages BIGINT, only_elements BIGINT",
        "('admin', 2, 1, 1)",
        "('guest', 1, 0, 0)",
    ),
    "golden_delivery": _rows(
        "delivery_id VARCHAR, status VARCHAR, attempts BIGINT, last_error VARCHAR",
        "('d1', 'delivered', 2, NULL)",
        "('d2', 'dead', 1, 'HTTP 400')",
        "('d3', 'pending', 3, 'HTTP 503')",
        "('d4', 'pending', 0, NULL)",
        "('d5', 'pending', 0, NULL)",
    ),
    "golden_payload": _rows(
        "payload VARCHAR",
        '(\'{"event":"page_discovered","run_id":"r1","timestamp":"2026-01-02T03:04:05.000Z","data":{"url":"u"},"role":"admin"}\')',
        '(\'{"event":"page_discovered","run_id":"r1","timestamp":"2026-01-02T03:04:05.000Z","data":{"url":"u"}}\')',
    ),
    "golden_signatures": _rows(
        "short VARCHAR, long VARCHAR",
        "('sha256=5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843', 'sha256=60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54')",
    ),
    "golden_role_names": _rows(
        "n BIGINT, fault VARCHAR, variable VARCHAR",
        "(0, NULL, 'APP_PASSWORD_ADMIN')",
        "(1, NULL, 'APP_PASSWORD_READ_ONLY')",
        "(2, 'clash', 'APP_PASSWORD_READ_ONLY')",
        "(3, 'repeated', 'APP_PASSWORD_ADMIN')",
        "(4, 'invalid', 'APP_PASSWORD_ADMIN')",
        "(5, 'reserved', 'APP_PASSWORD_PAGES')",
        "(6, 'invalid', 'APP_PASSWORD_9LIVES')",
        "(7, 'invalid', NULL)",
        "(8, NULL, 'APP_PASSWORD_GUEST')",
        "(9, 'invalid', 'APP_PASSWORD_AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA')",
    ),
    "golden_trusted": _rows(
        "n BIGINT, trusted BOOLEAN",
        "(0, true)",
        "(1, false)",
        "(2, true)",
        "(3, true)",
        "(4, false)",
    ),
    "golden_coverage": _rows(
        "page_url VARCHAR, stored BIGINT",
        "('https://x.org/login', 4)",
        "('https://x.org/orders', 0)",
        "('https://x.org/contact', 4)",
    ),
    "golden_explained": _rows(
        "signal VARCHAR, similarity DOUBLE",
        "('stable_attr', NULL)",
        "('name', NULL)",
        "('text', 1.0)",
        "('aria_label', NULL)",
        "('label', NULL)",
        "('attributes', 1.0)",
        "('dom_path', 1.0)",
        "('id', NULL)",
        "('classes', NULL)",
        "('parent', 1.0)",
        "('sibling_index', 1.0)",
    ),
}
