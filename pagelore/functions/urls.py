"""URL columns: parts, normal forms, resolution, filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """Authority part in lower case, '' when there is none (regexp: never fails, keeps odd hosts)."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def hostname(url: Column) -> Column:
    """Host without user part and port."""
    return F.regexp_replace(F.regexp_replace(host(url), r"^[^@]*@", ""), r":\d*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_and_query(url: Column) -> Column:
    """What robots rules are compared with: the path, and the query with its question mark."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def path_depth(url: Column) -> Column:
    return F.size(path_parts(url))


def params_count(url: Column) -> Column:
    q = query_string(url)
    return F.when(q == "", 0).otherwise(F.size(F.split(q, "&")))


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))


def url_kind(url: Column) -> Column:
    """Kind by scheme, as cache rules see it."""
    return (F.when(url.startswith("https://"), "web_https").when(url.startswith("http://"), "web_http")
            .when(url.startswith("file://"), "local_file").when(url.startswith("raw:"), "raw_html")
            .when(url.startswith("data:"), "data_uri").when(url.startswith("ftp://"), "ftp").otherwise("unknown"))


# Parameters dropped by normalisation.
TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid")


def normalize(url: Column, strict: bool = False) -> Column:
    """Trailing slashes and tracking parameters removed.

    With strict=True a dropped first parameter takes its '?' along, so `p?utm_source=a&b=1` becomes `p&b=1`;
    the default repairs the separator.
    """
    u = F.regexp_replace(F.coalesce(url, F.lit("")), r"/+$", "")
    u = F.regexp_replace(u, "[?&](?:" + "|".join(TRACKING_PARAMETERS) + ")=[^&]*", "")
    u = F.regexp_replace(F.regexp_replace(u, r"\?&", "?"), r"&&+", "&")
    if not strict:
        u = F.when(F.contains(u, F.lit("?")), u).otherwise(F.regexp_replace(u, r"^([^&]*)&", "$1?"))
    return F.regexp_replace(u, r"[?&]+$", "")


def map_normalize(url: Column) -> Column:
    """Comparison form of the site map: no fragment, no trailing slash, no www., lower case."""
    u = F.regexp_replace(url, r"#.*$", "")
    u = F.when(u.endswith("/") & (path(url) != "/"), F.regexp_replace(u, r"/$", "")).otherwise(u)
    return F.lower(F.replace(u, F.lit("://www."), F.lit("://")))


def squash_dots(p: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path by a fold over its segments."""
    segs = F.split(p, "/")
    folded = F.aggregate(
        F.slice(segs, F.lit(2), F.greatest(F.size(segs) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    tail = F.when(p.rlike(r"/\.\.?$"), "/").otherwise("")
    out = F.concat(F.lit("/"), F.array_join(folded, "/"), tail)
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.regexp_replace(out, "^//", "/")).otherwise(p)


def resolve(base: Column, ref: Column) -> Column:
    """Absolute URL of a reference: scheme, //, /, ?, # and relative forms, dot segments folded."""
    return F.get(F.transform(F.array(F.trim(ref)), lambda r: _resolve(base, r)), F.lit(0))


def _resolve(base: Column, ref: Column) -> Column:
    sch = scheme(base)
    root = F.concat(sch, F.lit("://"), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    base_path = path(base)
    folder = F.regexp_replace(F.when(base_path == "", "/").otherwise(base_path), r"[^/]*$", "")
    split_at = r"^([^?#]*)(.*)$"
    ref_path = F.regexp_extract(ref, split_at, 1)
    ref_tail = F.regexp_extract(ref, split_at, 2)
    no_frag = F.regexp_replace(base, r"#.*$", "")
    # the common form of a link, whose parts need not be looked for
    rooted = ref.rlike(r"^/(?!/)[^\n\r\u0085\u2028\u2029]*\z") & ~F.contains(ref, F.lit("/."))
    return (F.when(ref.isNull() | (ref == ""), base)
            .when(rooted, F.concat(root, ref))
            .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
            .when(ref.startswith("//"), F.concat(sch, F.lit(":"), ref))
            .when(ref.startswith("#"), F.concat(no_frag, ref))
            .when(ref.startswith("?"), F.concat(root, base_path, ref))
            .when(ref.startswith("/"), F.concat(root, squash_dots(ref_path), ref_tail))
            .otherwise(F.concat(root, squash_dots(F.concat(folder, ref_path)), ref_tail)))


def ancestors(url: Column) -> Column:
    """URLs of the parent folders, nearest root first."""
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    parts = path_parts(url)
    n = F.size(parts)
    up = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                     lambda i: F.concat(root, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(n >= 2, up).otherwise(F.array().cast("array<string>"))


# ---- filters -------------------------------------------------------------------------------------------------

def any_in(values, c: Column) -> Column:
    """True when the text contains one of the given strings; an OR of contains() stays in generated code."""
    out = F.lit(False)
    for v in values:
        out = out | F.contains(c, F.lit(v))
    return out


def domain_ok(url: Column, allowed=(), blocked=(), same_domain: str | None = None) -> Column:
    h = host(url)
    ok = F.lit(True)
    if same_domain:
        ok = ok & (h == same_domain.lower())
    if blocked:
        ok = ok & ~any_in([b.lower() for b in blocked], h)
    if allowed:
        ok = ok & any_in([a.lower() for a in allowed], h)
    return ok


def pattern_ok(url: Column, include=(), exclude=()) -> Column:
    ok = F.lit(True)
    if exclude:
        ok = ok & ~url.rlike("|".join(f"(?:{p})" for p in exclude))
    if include:
        ok = ok & url.rlike("|".join(f"(?:{p})" for p in include))
    return ok


# Extensions and types of the content filter, patterns of the structure filter.
BLOCKED_EXTENSIONS = ("pdf doc docx xls xlsx ppt pptx zip tar gz rar 7z mp4 avi mov wmv flv mp3 wav flac aac "
                      "jpg jpeg png gif bmp svg webp").split()
ALLOWED_TYPES = ("text/html", "application/xhtml+xml")
BAD_URL_PATTERNS = (r"/cgi-bin/", r"/admin/", r"/private/", r"/tmp/", r"\?.*sessionid", r"\?.*sid=",
                    r"\?.*PHPSESSID", r"\.php\?.*&.*&.*&", r"javascript:", r"mailto:")


def content_type_ok(url: Column, content_type: Column, allowed=ALLOWED_TYPES, blocked=()) -> Column:
    ext_ok = ~F.lower(path(url)).rlike(r"\.(?:" + "|".join(BLOCKED_EXTENSIONS) + ")$")
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    type_ok = (ct == "") | (any_in(allowed, ct) & ~any_in(blocked, ct))
    return ext_ok & type_ok


def structure_ok(url: Column, max_depth: int = 5, max_params: int = 10) -> Column:
    return ((path_depth(url) <= max_depth) & (params_count(url) <= max_params)
            & ~url.rlike("(?i)" + "|".join(BAD_URL_PATTERNS)))


def url_words(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit("([a-z]+)"), 1))


def query_overlap(url: Column, query_tokens: Column) -> Column:
    return F.size(F.array_intersect(query_tokens, url_words(url))) / F.size(query_tokens)


def relevance_ok(url: Column, query_tokens: Column, min_score: float = 0.3) -> Column:
    return (F.size(query_tokens) == 0) | (query_overlap(url, query_tokens) >= min_score)


def site_scope_ok(url: Column, base: str, external: bool = False, subdomains: bool = True,
                  by_path: bool = False, include=(), exclude=()) -> Column:
    b = F.lit(base)
    ok = scheme(url).isin("http", "https")
    if not external:
        ok = ok & (host(url).endswith(host(b)) if subdomains else host(url) == host(b))
    if by_path:
        ok = ok & ((path(b).isin("", "/")) | path(url).startswith(path(b)))
    return ok & pattern_ok(url, include, exclude)


PRIVATE_IPV4 = (r"^(?:0\.|10\.|127\.|169\.254\.|192\.168\.|192\.0\.0\.|192\.0\.2\.|198\.1[89]\.|198\.51\.100\.|"
                r"203\.0\.113\.|172\.(?:1[6-9]|2\d|3[01])\.|2[45]\d\.)\d+")


def is_private_host(h: Column) -> Column:
    return (h.rlike(r"^\d+\.\d+\.\d+\.\d+$") & h.rlike(PRIVATE_IPV4)) | h.rlike(
        r"^\[?(?:::1?|f[cd][0-9a-f]*:.*|fe[89ab][0-9a-f]:.*)\]?$")


def is_safe(url: Column, allowed_hosts=()) -> Column:
    h = hostname(url)
    ok = scheme(url).isin("http", "https") & (h != "") & ~is_private_host(h) & (h != "localhost")
    return ok & h.isin(list(allowed_hosts)) if allowed_hosts else ok
