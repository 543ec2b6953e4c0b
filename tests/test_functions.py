"""URL, id and text functions on the cases that pin their semantics."""

import hmac

import pytest
from pyspark.sql import functions as F

from sitelode.functions import text as T
from sitelode.functions import urls as U
from sitelode.operators import access
from sitelode.streaming import outbox


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://User:pw@Example.COM:80/a/b//?b=2&a=1#frag", "http://example.com/a/b?a=1&b=2"), ("https://x.org:443", "https://x.org/"), ("https://x.org:8443/", "https://x.org:8443/"),
        ("http://x.org/p;jsessionid=AB12?utm_source=z&q=a+b&gclid=1", "http://x.org/p?q=a+b"), ("http://x.org/#/route", "http://x.org/#/route"), ("http://x.org/#!r", "http://x.org/#!r"), ("http://x.org/?q=", "http://x.org/?q="),
        ("http://x.org/?q=%C3%A9~*", "http://x.org/?q=%C3%A9~%2A"), ("http://[::1]:81/a", "http://[::1]:81/a"), ("http://x.org:port/", None), (" http://x.org/a ", "http://x.org/a"), (None, None),
    ],
)
def test_normalize_url(spark, raw, want):
    assert one(spark, U.normalize_url("u"), u=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("row-12-cell", "row-{n}-cell"), ("btn_a3f9c2d81b", "btn_{hex}"), ("x-123e4567-e89b-12d3-a456-426614174000", "x-{uuid}"), ("facade-button", "facade-button"), ("", None), (None, None), ("deadbeef", "deadbeef")])
def test_normalize_id(spark, raw, want):
    # the underscore counts as a delimiter of a hexadecimal fragment
    assert one(spark, U.normalize_id("u"), u=raw) == want


def test_other_url_functions(spark):
    assert one(spark, U.template_key("u"), u="http://x.org/p/42/a-7?b=1") == "http://x.org/p/{n}/a-{n}?b=1"
    assert one(spark, U.host_key("u"), u="http://www.x.org/") == "x.org" and one(spark, U.host_key("u"), u="http://blog.x.org/") == "blog.x.org"
    assert one(spark, U.is_page_url("u"), u="http://x.org/a.PDF") is False and one(spark, U.is_page_url("u"), u="http://x.org/a.html") is True and one(spark, U.is_page_url("u"), u="mailto:a@b") is False
    assert one(spark, U.is_oauth_url("u"), u="https://id.x.org/oauth2/go") is True and one(spark, U.is_oauth_url("u"), u="https://x.org/?client_id=1") is False
    assert one(spark, U.redact_url("u"), u="https://a:b@x.org/p?q#f") == "https://x.org/p" and one(spark, U.mask_password("u"), u="postgres://a:b@h/d") == "postgres://a:***@h/d"
    assert one(spark, U.output_file(F.lit(7), "u"), u="http://example.com/Orders/42") == "pages/0007-example.com-orders-42.json"


@pytest.mark.parametrize(("label", "want"), [("next", "next"), ("older", "next"), ("next »", "next"), ("« previous", "prev"), ("›", "next"), ("‹", "prev"), ("next page", "next"), ("newer", "prev"), ("2", None), ("next step", None), ("", None)])
def test_page_direction(spark, label, want):
    assert one(spark, T.page_direction("u"), u=label) == want


def test_text(spark):
    assert one(spark, T.slug("u"), u="Sign In – Café!") == "sign-in-caf" and one(spark, T.words("u"), u="deleteBtn_2x") == "delete btn 2x"
    assert T.similarity_of("Sign in", "sign  IN") == 1 and T.similarity_of("abc", "xyz") == 0
    rows = spark.createDataFrame([("Sign in", "sign  in"), ("Log in", "Login"), ("a", None), (None, None)], "a string, b string").select(T.text_similarity("a", "b").alias("s")).collect()
    assert [r.s for r in rows] == [1.0, T.similarity_of("Log in", "Login"), None, None]


def test_secret_paths():
    config = {"crawl": {"api_key": 1, "urls": [{"url": "u"}, {"Password": "x", "inner": {"loginToken": 2}}]}, "mode": "guided"}
    assert list(access.secret_paths(config)) == ["crawl.api_key", "crawl.urls[1].Password", "crawl.urls[1].inner.loginToken"]
    assert not list(access.secret_paths({"mode": "guided", "roles": ["a"]})) and not list(access.secret_paths(None))


def test_signature_of_nulls_and_any_text(spark):
    texts = ["", "ä€\n", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, body string")
    got = {r["n"]: r["s"] for r in rows.select("n", outbox.signature("clé", "body").alias("s")).collect()}
    assert got == {i: t if t is None else "sha256=" + hmac.new("clé".encode(), t.encode(), "sha256").hexdigest() for i, t in enumerate(texts)}


def test_access_over_empty_tables(spark):
    assert access.role_faults(spark.createDataFrame([], "n long, role string")).count() == 0
    urls = spark.createDataFrame([("https://s.example/",)], "url string")
    assert access.trusted_targets(urls, urls.limit(0)).collect()[0]["trusted"] is False
