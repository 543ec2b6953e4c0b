"""Elements, types, discovery, healing, roles, forms, scripts and delivery on small pages and tables."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from sitelode.operators import classify, discovery, elements, forms, healing, roles, rolediff, scripts
from sitelode.plans import queries
from sitelode.sources import documents, html
from sitelode.streaming import outbox

LOGIN = '<html><body><form><label for="u">User</label><input id="u" name="user"><input type="password" value="s3cret"><button type="submit">Sign in</button></form><a href="/sso">Continue with Google</a></body></html>'
LIST = "<html><body><h1>Orders</h1><table>" + "".join(f'<tr class="row"><td>{i}</td><td>x{i}</td></tr>' for i in range(6)) + '</table><a rel="next" href="?page=2">Next</a></body></html>'
NAV = "<html><body><nav><ul>" + "".join(f'<li><a href="/s{i}.html">S {i}</a>' for i in range(8)) + "</ul></nav></body></html>"
SEARCH = '<body><form><input type="search" name="q"><select><option>a</select><input type="checkbox"></form><div class="search-results"><p>hit</div></body>'
BROKEN = "<body><p><b>one<br><p>two <b>x</b> three<ul><li>a<li>b</ul><script>var t='</p>';</script><!-- <p> -->"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://x.org/login", LOGIN), (2, "https://x.org/orders", LIST), (3, "https://x.org/", NAV), (4, "https://x.org/search?q=a", SEARCH), (5, "https://x.org/broken", BROKEN), (6, "https://x.org/none", None), (7, None, "")]
    return elements.with_ids(html.elements(spark.createDataFrame(rows, "page_id long, url string, html string"))).cache()


def test_elements(pages):
    rows = {(r.page_id, r.doc_idx): r for r in pages.collect()}
    login = [r for (p, _), r in sorted(rows.items()) if p == 1]
    assert [r.tag for r in login] == ["html", "body", "form", "label", "input", "input", "button", "a"]
    user, password, link = login[4], login[5], login[7]
    assert user.css_selector == "#u" and user.xpath == '//*[@id="u"]' and user.dom_context.nearby_label_text == "User" and user.dom_context.tag_path == ["html", "body", "form", "input"]
    assert password.attributes["value"] == "[redacted]" and password.css_selector == "html > body > form > input:nth-of-type(2)" and link.computed.href == "https://x.org/sso"
    broken = [(r.tag, r.text_content) for (p, _), r in sorted(rows.items()) if p == 5]
    assert [t for t, _ in broken].count("li") == 2 and "script" not in [t for t, _ in broken] and ("p", None) in broken  # the open <b> goes on into the next paragraph


def test_counts_and_hash(pages):
    n = {r.page_id: r for r in elements.element_counts(pages).collect()}
    assert n[1].total == 8 and n[1].by_tag["input"] == 2 and n[2].by_tag["tr"] == 6 and n[1].by_frame == {"main": 8}
    import hashlib

    got = {r.page_id: r.structural_hash for r in elements.structural_hash(pages).collect()}
    rows = [r for r in pages.collect() if r.page_id == 1]
    signatures = sorted({(r.tag, r.dom_context.parent_tag or "", r.id_normalized or "", r.name or "", r.attributes.get("type", ""), r.attributes.get("role", ""), 1, False) for r in rows})
    assert got[1] == hashlib.sha256(json.dumps(signatures).encode()).hexdigest()[:16]


def test_structural_hash_escapes_like_json(spark, pages):
    odd = pages.where("page_id = 1 and doc_idx = 4").withColumn("name", F.lit('é"\\😀\n'))
    r = odd.first()
    import hashlib

    want = [["input", r.dom_context.parent_tag, "u", 'é"\\😀\n', "", "", 1, False]]
    assert elements.structural_hash(odd).first().structural_hash == hashlib.sha256(json.dumps(want).encode()).hexdigest()[:16]


def test_page_types(pages):
    got = {r.page_id: r for r in classify.classify(pages).collect()}
    assert [got[i].page_type for i in (1, 2, 3, 4)] == ["login", "list", "nav_shell", "search"]
    assert "password_input" in got[1].signals["login"] and got[1].confidence == got[1].scores["login"] == 1.0


def test_links_and_scope(spark, pages):
    found = elements.links(pages)
    assert {r.url for r in found.where("page_id = 3").collect()} == {f"https://x.org/s{i}.html" for i in range(8)}
    starts = spark.createDataFrame([("http://www.x.org/",)], "url string")
    assert discovery.in_scope(found, starts).count() == found.count() and discovery.in_scope(found, starts, scope="same_origin").count() == 0


def test_frontier_defers_templates(spark):
    edges = [("http://h/a", i, f"http://h/p/{i}") for i in range(6)] + [("http://h/a", 9, "http://h/b"), ("http://h/b", 0, "http://h/c"), ("http://h/p/0", 0, "http://h/a")]
    e = spark.createDataFrame(edges, "src string, pos int, dst string")
    order, status = discovery.frontier(e, ["http://h/a"], max_pages=20, template_sample=2)
    assert [r.url[8:] for r in order.orderBy("visit_seq").collect()] == ["/a", "/p/0", "/p/1", "/b", "/c", "/p/2", "/p/3", "/p/4", "/p/5"] and status == "complete"
    order, status = discovery.frontier(e, ["http://h/a"], max_pages=3)
    assert order.count() == 3 and status == "max_pages_reached"
    depth = {r.url: r.depth for r in discovery.reachable(e, spark.createDataFrame([("http://h/a",)], "url string")).collect()}
    assert depth["http://h/c"] == 2 and len(depth) == 9 and set(depth) == {r.url for r in discovery.frontier(e, ["http://h/a"], 99)[0].collect()}


def test_manifest(spark):
    v = spark.createDataFrame([(1, "u1", "h", "list", "pending"), (2, "u2", "h", "form", "extracted"), (3, "u1", "z", "x", "pending"), (4, "u3", None, "x", "failed"), (5, "u4", None, "x", "failed")], "visit_seq long, url string, structural_hash string, page_type string, status string")
    m = discovery.manifest(v).cache()
    assert [(r.url, r.variant_urls, r.page_type) for r in m.orderBy("page_no").collect()] == [("u1", ["u2"], "list"), ("u3", [], "x"), ("u4", [], "x")]
    assert discovery.manifest(v, by_structure=False).count() == 4 and discovery.remaining(m).count() == 3
    marked = discovery.mark(m, spark.createDataFrame([("u1", "extracted")], "url string, status string"))
    assert discovery.counts(marked).first().pages_extracted == 1
    with pytest.raises(Exception, match="no such page"):
        discovery.mark(m, spark.createDataFrame([("zz", "extracted")], "url string, status string")).collect()
    assert {r.url: r.page_url for r in discovery.aliases(m).collect()}["u2"] == "u1"


def test_roles(pages):
    got = [r.role for r in roles.assign_roles(pages).where("page_id = 1").orderBy("doc_idx").collect()]
    assert got == ["textbox:user", "textbox", "button:sign-in", "link:continue-with-google"]


def test_healing(spark, pages):
    old = pages.where("page_id = 1")
    store = healing.fingerprints(old).cache()
    same = {r.element_role: r for r in healing.resolve(store, old).collect()}
    assert all(r.outcome == "exact" for r in same.values()) and same["textbox:user"].confidence is None
    moved = old.withColumn("id", F.when(F.col("tag") == "input", F.lit(None)).otherwise(F.col("id"))).withColumn("id_normalized", F.lit(None).cast("string"))
    moved = moved.withColumn("css_selector", F.concat("css_selector", F.lit(" > x"))).withColumn("xpath", F.concat("xpath", F.lit("/x")))
    found = healing.resolve(store, moved).cache()
    user = found.where("element_role = 'textbox:user'").first()
    assert user.outcome == "healed" and user.kind == "fallback" and user.strategy == "name"
    new, history = healing.heal(store, found, F.lit("2026-01-01T00:00:00.000Z"))
    assert new.count() == store.count() and {r.change_kind for r in history.collect()} == {"churn"}
    gone = {r.element_role: r for r in healing.resolve(store, pages.where("page_id = 2").withColumn("page_url", F.lit("https://x.org/login"))).collect()}
    assert all(r.outcome == "failed" and r.reason == "below_threshold" for r in gone.values())
    other = healing.changes(store.select(F.struct(*healing.FIELDS).alias("old"), F.struct(*healing.FIELDS).alias("new")).withColumn("new", F.col("new").withField("text_content", F.lit("Delete all")))).where("old.tag = 'button'").first()
    assert other.change_kind == "regression" and other.changed_fields == ["text_content"]


def test_heal_resolve(spark, tmp_path):
    """Each fingerprint counts once, also of two captures of one URL, and the driver plans a step at a time."""
    rows = [(1, "https://x.org/login", LOGIN), (2, "https://x.org/login", LOGIN), (3, "https://x.org/", NAV)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = queries.heal_resolve(spark, str(tmp_path))
    got = found.collect()
    assert sum(r.n for r in got) == 16 and {r.outcome for r in got} == {"exact"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") < 10  # 47 with the steps in one plan


def test_resume_set(spark, tmp_path):
    """As its SQL: numbers of more than four digits, marks of a query or a path elsewhere in the URL, no URL."""
    urls = ["http://h.org/fr/a", "http://h.org/fr/a?b=1", "http://h.org/fr/a?", "http://h.org/fr/a#x?y", "http://h.org/en/a?to=/fr/b", "http://h.org/de/" + "long-" * 20, "", None]
    rows = [(n + i, u) for n in (0, 9996, 12345, 2**31) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = db.execute(queries.SQL["resume_set"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.resume_set(spark, str(tmp_path)).collect())
    names = spark.createDataFrame([(7,), (10000,), (2**31,)], "n long").select(discovery.output_file("n", F.lit("http://h.org/a")).alias("f"))
    assert [r.f for r in names.collect()] == ["pages/0007-h.org-a.json", "pages/10000-h.org-a.json", "pages/2147483648-h.org-a.json"]


def test_store(spark, pages, tmp_path):
    store = healing.fingerprints(pages.where("page_id = 1"))
    again, summary = healing.record(store, healing.fingerprints(pages.where("page_id in (1, 3)")))
    assert summary.first().asDict() == {"added": 8, "refreshed": 0, "kept": 4} and again.count() == 12
    assert healing.record(store, store, refresh=True)[1].first().refreshed == 4
    snapshots = documents.SnapshotStore(spark, str(tmp_path / "store"))
    history = spark.createDataFrame([(1, "p", "r", "t", "churn")], "id long, page_url string, element_role string, at string, change_kind string")
    assert snapshots.current() is None and snapshots.commit(store, history) == 1 and snapshots.commit(again, history) == 2
    assert snapshots.read("fingerprints").count() == 12


def test_role_differences(spark):
    pages = spark.createDataFrame([("admin", "u", "extracted", ["v"]), ("admin", "w", "failed", []), ("guest", "u", "extracted", [])], "role string, url string, status string, variant_urls array<string>")
    d = rolediff.page_differences(rolediff.reached(pages), ["admin", "guest"]).collect()
    assert [(r.url, r.roles, r.missing) for r in d] == [("v", ["admin"], ["guest"])]
    names = spark.createDataFrame([("admin", "u", "a"), ("guest", "u", "a"), ("admin", "u", "b"), ("admin", "x", "c")], "role string, url string, element string")
    e = rolediff.element_differences(names, names.select("role", "url").distinct(), ["admin", "guest"]).collect()
    assert [(r.url, r.element, r.roles, r.missing) for r in e] == [("u", "b", ["admin"], ["guest"])]


def test_forms_and_clicks(spark, pages):
    f = {r.page_id: r for r in forms.login_forms(pages).collect()}
    # the selector of an element with an id starts at the id, so it isn't inside the form
    assert (f[1].username, f[1].password, f[1].submit, f[1].sso, f[1].action) == (None, 5, 6, [7], "password") and f[3].action == "none"
    assert {r.page_id: r.mfa for r in forms.login_states(pages).collect()}[1] is False
    page = '<body><button>Show <i>more</i></button><button>Delete</button><div onclick="go()">Tab</div><form><button>Go</button></form><button>Show more</button><a href="#">Menu</a></body>'
    e = elements.with_ids(html.elements(spark.createDataFrame([(1, "http://x/", page)], "page_id long, url string, html string")))
    chosen, totals = forms.click_candidates(e, limit=2)
    assert [r.label for r in chosen.orderBy("doc_idx").collect()] == ["Show more", "Tab"] and totals.first().asDict() == {"page_id": 1, "candidates": 2, "skipped_unsafe": 2, "over_limit": 1}


def test_page_specs(pages):
    kinds = classify.classify(pages)
    s = {r.page_id: r for r in scripts.page_specs(pages, kinds).collect()}
    assert [(x.method, x.action, x.value) for x in s[1].elements] == [("fill_user", "fill", "{USERNAME}"), ("fill_textbox", "fill", "{PASSWORD}"), ("click_sign_in", "click", None), ("click_continue_with_google", "click", None)]
    assert [(x.action, x.role) for x in s[1].steps] == [("fill", "textbox:user"), ("fill", "textbox"), ("click", "button:sign-in")] and s[1].class_name == "LoginPage" and s[3].function_name == "home"


def test_delivery(spark):
    box = spark.createDataFrame([(i, f"d{i}", "pending", 0, None) for i in range(1, 6)], "seq long, delivery_id string, status string, attempts int, last_error string")
    log = spark.createDataFrame([("d1", 1, 500), ("d1", 2, 200), ("d2", 1, 400), ("d3", 1, 500), ("d3", 2, None), ("d3", 3, 503), ("d4", 1, 200)], "delivery_id string, n int, status int")
    got = {r.delivery_id: r for r in outbox.deliver(box, log).collect()}
    assert [got[f"d{i}"].status for i in range(1, 6)] == ["delivered", "dead", "pending", "pending", "pending"] and got["d1"].attempts == 2 and got["d3"].last_error == "HTTP 503" and got["d4"].attempts == 0
    assert outbox.next_pending(outbox.retry_dead(outbox.deliver(box, log))).first().delivery_id == "d2"


def test_events(spark, tmp_path):
    rows = [("login_failed", "r", {"url": "u", "reason": "timeout", "screenshot_ref": "s"}), ("login_failed", "r", {"url": "u", "reason": "odd", "screenshot_ref": "s"}), ("nope", "r", {}), ("page_discovered", "", {"url": "u", "page_type": "x", "structural_hash": "h"}), ("page_discovered", "r", {"url": "u"})]
    e = spark.createDataFrame(rows, "event string, run_id string, data map<string,string>")
    assert [r.f for r in e.select(outbox.event_fault().alias("f")).collect()] == [None, "unknown reason", "unknown event", "no run id", "missing fields"]
    src = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:00:01"), ("b", "2026-01-01 00:00:02")], "delivery_id string, ts string")
    src.write.parquet(str(tmp_path / "in"))
    seen: list = []
    stream = outbox.received_once(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    outbox.fan_out(stream, [lambda b, n: seen.extend(r.delivery_id for r in b.collect()), lambda b, n: None], str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["a", "b"]


def test_page_files(spark, pages, tmp_path):
    docs = elements.page_documents(pages, spark.createDataFrame([(1, "https://x.org/login")], "page_id long, url string")).withColumn("page_type", F.lit("login"))
    documents.write_pages(docs, str(tmp_path / "out"))
    read, bad = documents.read_pages(spark, str(tmp_path / "out/*.json"))
    assert documents.elements_of(read).count() == 8 and bad.count() == 0
