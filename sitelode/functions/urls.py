"""URL and id functions as column expressions; everything runs inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What must be equal for equal results.
NOISE_PARAMS = ("gclid", "fbclid", "msclkid", "dclid", "yclid", "mc_cid", "mc_eid", "_ga", "_gl", "sessionid", "session_id", "sid", "phpsessid", "jsessionid", "sessid", "cfid", "cftoken")
NOISE_PREFIX = "utm_"
NON_PAGE_EXTENSIONS = (
    "pdf", "zip", "gz", "tar", "rar", "7z", "exe", "dmg", "msi", "apk", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp", "mp3", "mp4",
    "mov", "avi", "webm", "wav", "css", "js", "json", "xml", "csv", "xls", "xlsx", "doc", "docx", "ppt", "pptx", "woff", "woff2", "ttf", "eot",
)
SSO_ENDPOINT = r"/oauth2?/|/authorize|/saml|/sso|/openid|/adfs/|login\.microsoftonline\.com|accounts\.google\.com|okta\.com|auth0\.com"

SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"
AUTHORITY = r"^(?:[\s\S]*@)?(\[[^\]]*\]|[^:]*)(?::([\s\S]*))?$"
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
HEX = r"(?i)(?<![0-9A-Za-z])(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?![0-9A-Za-z])"


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def url_part(url: Column | str, part: str) -> Column:
    """scheme, netloc, path, query or fragment; '' where there is none. Unlike parse_url() it gives up on no input."""
    at = ("scheme", "netloc", "path", "query", "fragment").index(part) + 1
    found = F.regexp_extract(F.regexp_replace(F.trim(column(url)), "[\t\r\n]", ""), SPLIT, at)
    return F.lower(found) if part == "scheme" else found


def hostname(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(url_part(url, "netloc"), AUTHORITY, 1))


def normalize_id(value: Column | str) -> Column:
    """Volatile parts of an id as placeholders: uuids, then hexadecimal fragments, then runs of digits. Empty is null."""
    v = F.nullif(column(value), F.lit(""))
    v = F.regexp_replace(v, UUID, "{uuid}")
    v = F.regexp_replace(v, HEX, "{hex}")
    return F.regexp_replace(v, r"(?U)\d+", "{n}")


def is_noise_param(name: Column) -> Column:
    return F.lower(name).isin(*NOISE_PARAMS) | F.startswith(F.lower(name), F.lit(NOISE_PREFIX))


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normal_query(query: Column) -> Column:
    """Parameters decoded, without noise, sorted by name and value, encoded again."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), _decoded(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~is_noise_param(p["k"])))
    return F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def _joined(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    return F.when(netloc.isNotNull(), F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""), path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    ))


def split_url(url: Column | str) -> Column:
    """struct<scheme, netloc, path, query, fragment>, as url_part() gives them, with the URL cleaned once."""
    def parts(u: Column) -> Column:
        found = [F.regexp_extract(u, SPLIT, i + 1) for i in range(5)]
        return F.struct(F.lower(found[0]).alias("scheme"), *(x.alias(n) for x, n in zip(found[1:], ("netloc", "path", "query", "fragment"), strict=True)))

    return let(F.regexp_replace(F.trim(column(url)), "[\t\r\n]", ""), parts)


def _normal_parts(p: Column) -> dict[str, Column]:
    """The canonical parts of a split URL."""
    scheme, netloc = p["scheme"], p["netloc"]
    host, port = F.lower(F.regexp_extract(netloc, AUTHORITY, 1)), F.regexp_extract(netloc, AUTHORITY, 2)
    bad = (port != "") & (~port.rlike("^[0-9]{1,5}$") | (port.try_cast("int") > 65535))
    number = port.try_cast("int").cast("string")
    default = ((scheme == "http") & (number == "80")) | ((scheme == "https") & (number == "443"))
    place = F.when(bad, F.lit(None).cast("string")).when((port == "") | default, host).otherwise(F.concat(host, F.lit(":"), number))
    path = F.regexp_replace(p["path"], r"(?i);jsessionid=[^/?#]*", "")
    path = F.when(F.rtrim(path, F.lit("/")) == "", "/").otherwise(F.rtrim(path, F.lit("/")))
    fragment = p["fragment"]
    return {"scheme": scheme, "netloc": place, "path": path, "query": normal_query(p["query"]), "fragment": F.when(fragment.rlike("^[/!]"), fragment).otherwise("")}


def _canonical(url: Column | str, of_path: Callable[[Column], Column] = lambda p: p) -> Column:
    def joined(p: Column) -> Column:
        parts = _normal_parts(p)
        return let(F.struct(*(c.alias(n) for n, c in parts.items())), lambda q: _joined(q["scheme"], q["netloc"], of_path(q["path"]), q["query"], q["fragment"]))

    return let(split_url(url), joined)


def normalize_url(url: Column | str) -> Column:
    """The canonical form of a URL; null for null, and for a port that isn't one."""
    return _canonical(url)


def template_key(url: Column | str) -> Column:
    """The canonical form with volatile path segments as placeholders."""
    return _canonical(url, lambda path: F.array_join(F.transform(F.split(path, "/"), lambda s: F.coalesce(normalize_id(s), s)), "/"))


def is_page_url(url: Column | str) -> Column:
    """An absolute http(s) URL whose last segment doesn't end like a resource."""
    last = F.substring_index(url_part(url, "path"), "/", -1)
    extension = F.when(F.contains(last, F.lit(".")), F.lower(F.substring_index(last, ".", -1))).otherwise("")
    return url_part(url, "scheme").isin("http", "https") & (url_part(url, "netloc") != "") & ~extension.isin(*NON_PAGE_EXTENSIONS)


def host_key(url: Column | str) -> Column:
    return F.regexp_replace(hostname(url), r"^www\.", "")


def origin(url: Column | str) -> Column:
    return F.concat(url_part(url, "scheme"), F.lit("://"), url_part(url, "netloc"))


def frame_origin(url: Column | str) -> Column:
    """Origin of a frame: file:// for files, null where it inherits (about:, data:, blob: and no URL), else scheme://netloc."""
    scheme = url_part(url, "scheme")
    return F.when((F.trim(column(url)) == "") | scheme.isin("about", ""), F.lit(None)).when(scheme == "file", "file://").when(scheme.isin("data", "blob", "javascript"), F.concat(F.lit("opaque:"), column(url))).otherwise(F.lower(origin(url)))


def same_page(a: Column | str, b: Column | str) -> Column:
    a, b = column(a), column(b)
    return F.coalesce(normalize_url(a) == normalize_url(b), a == b)


def redact_url(url: Column | str) -> Column:
    """Without user, query and fragment."""
    return _joined(url_part(url, "scheme"), F.regexp_replace(url_part(url, "netloc"), r"^[\s\S]*@", ""), url_part(url, "path"), F.lit(""), F.lit(""))


def mask_password(url: Column | str) -> Column:
    return F.regexp_replace(column(url), r"(://[^:/@?#]*):[^@/?#]*@", "$1:***@")


def is_oauth_url(url: Column | str) -> Column:
    """Whether host and path look like an identity provider's; the query doesn't count."""
    return F.concat(F.lower(url_part(url, "netloc")), F.lower(url_part(url, "path"))).rlike(SSO_ENDPOINT)


def href_tail(href: Column | str) -> Column:
    return F.nullif(F.substring_index(F.rtrim(F.regexp_replace(column(href), r"[?#][\s\S]*$", ""), F.lit("/")), "/", -1), F.lit(""))


def page_slug(url: Column | str) -> Column:
    """What of a URL stands in a file's name; '' where nothing can."""
    text = F.lower(F.concat(url_part(url, "netloc"), url_part(url, "path"), F.lit(" "), url_part(url, "query")))
    slug = F.btrim(F.regexp_replace(text, "[^a-z0-9.]+", "-"), F.lit("-."))
    return F.rtrim(F.substring(slug, 1, 60), F.lit("-."))


def output_file(index: Column | str, url: Column | str) -> Column:
    """The file of a page: its whole number, of four digits at least, and its slug."""
    slug = page_slug(url)
    return F.format_string("pages/%04d-%s.json", column(index).cast("long"), F.when(slug == "", "page").otherwise(slug))
