"""Row checks: reason codes, sanitising, masking, suspicious requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U

# Fixed values of the validators.
SUSPICIOUS_QUERY = (r"<script[^>]*>.*?</script>", r"javascript:", r"vbscript:", r"onload\s*=", r"onerror\s*=",
                    r"onclick\s*=", r"data:text/html", r"expression\s*\(")
ENGINES = "google bing duckduckgo startpage qwant yahoo searx brave ecosia yandex".split()
HOST_PATTERN = (r"^[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?"
                r"(\.[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)*$")
SQL_WORDS = "UNION SELECT INSERT UPDATE DELETE DROP CREATE ALTER EXEC EXECUTE".split()
SCRIPT_WORDS = "SCRIPT JAVASCRIPT VBSCRIPT".split()
SENSITIVE_KEYS = ("password api_key token secret auth authorization x-api-key cookie session private "
                  "credential").split()
SUSPICIOUS_AGENTS = ("sqlmap nikto nmap masscan zap burp acunetix nessus openvas w3af dirb gobuster dirbuster "
                     "wfuzz ffuf").split()
SUSPICIOUS_PATHS = "admin phpmyadmin wp-admin config backup shell cmd eval exec system passwd".split()
SCALAR_LIMITS = {"timeout": (5, 120), "cache_ttl": (0, 86400), "max_results": (1, 100)}


def query_reasons(q: Column) -> Column:
    t = F.trim(F.coalesce(q, F.lit("")))
    return F.array_compact(F.array(
        F.when(t == "", "query_empty"), F.when(F.length(t) > 500, "query_too_long"),
        F.when(t.rlike("(?i)" + "|".join(SUSPICIOUS_QUERY)), "query_harmful")))


def url_reasons(u: Column) -> Column:
    h = U.hostname(u)
    is_ip = h.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    return F.array_compact(F.array(
        F.when(F.coalesce(u, F.lit("")) == "", "url_empty"),
        F.when(~U.scheme(u).isin("http", "https"), "url_scheme"), F.when(h == "", "url_host_missing"),
        F.when(u.rlike("[<>\"'`]"), "url_characters"), F.when(U.is_private_host(h), "url_private"),
        F.when((h != "") & ~is_ip & ~h.rlike(HOST_PATTERN), "url_host_form")))


def engines_normal(e: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(e, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def engine_reasons(e: Column) -> Column:
    n = engines_normal(e)
    bad = F.filter(n, lambda x: ~x.isin(ENGINES))
    return F.array_compact(F.array(F.when(F.size(n) == 0, "engines_empty"),
                                   F.when(F.size(bad) > 0, F.concat(F.lit("engine_unknown:"), F.array_join(bad, "|")))))


def language_reason(c: Column) -> Column:
    return F.array_compact(F.array(F.when(~F.lower(F.trim(c)).rlike("^[a-z]{2}$"), "language_code")))


def range_reason(name: str, c: Column) -> Column:
    lo, hi = SCALAR_LIMITS[name]
    return F.array_compact(F.array(F.when(c < lo, f"{name}_too_low"), F.when(c > hi, f"{name}_too_high")))


def sanitize_input(c: Column, max_length: int | None = None) -> Column:
    """No quotes or angle brackets, no SQL or script words; cut to a length first if one is given (a service took 1000)."""
    t = F.regexp_replace(c if max_length is None else F.substring(c, 1, max_length), "[<>\"']", "")
    t = F.regexp_replace(t, r"(?i)\b(?:" + "|".join(SQL_WORDS) + r")\b|--|/\*|\*/", "")
    t = F.regexp_replace(t, r"(?i)\b(?:" + "|".join(SCRIPT_WORDS) + r")\b", "")
    return F.coalesce(F.trim(t), F.lit(""))


def clean_query(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "[;'\"\\\\]", ""))


def mask(m: Column, keys=SENSITIVE_KEYS) -> Column:
    """Values of sensitive keys of a map<string,string> hidden."""
    def one(k, v):
        hidden = F.when(F.length(v) > 8, F.concat(F.left(v, F.lit(4)), F.lit("****"), F.right(v, F.lit(4)))).otherwise("****")
        return F.when(U.any_in(keys, F.lower(k)), hidden).otherwise(v)

    return F.transform_values(m, one)


def suspicious_request(agent: Column, path: Column) -> Column:
    return U.any_in(SUSPICIOUS_AGENTS, F.lower(F.coalesce(agent, F.lit("")))) | U.any_in(
        SUSPICIOUS_PATHS, F.lower(F.coalesce(path, F.lit(""))))


# Domains of tracking pixels.
TRACKER_DOMAINS = ("google-analytics.com", "googletagmanager.com", "facebook.com/tr", "doubleclick.net",
                   "scorecardresearch.com", "quantserve.com", "amazon-adsystem.com")


def tracking_pixel(src: Column, width: Column, height: Column) -> Column:
    px = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("px"), F.lit("")).try_cast("int")
    w, h = px(width), px(height)
    small = w.isNotNull() & h.isNotNull() & ((w <= 3) | (h <= 3))
    return small | U.any_in(TRACKER_DOMAINS, src)


def cache_rule(url: Column, rules: list[dict], default_mode: str = "enabled"):
    """(mode, ttl) of the matching rule with the highest priority; rules come as a list of
    {pattern, mode, ttl, priority} and become one CASE expression, tested in priority order."""
    kind, h = U.url_kind(url), U.host(url)
    mode = ttl = None
    for r in sorted(rules, key=lambda r: -r.get("priority", 0)):
        p = r["pattern"]
        if p == "*":
            hit = F.lit(True)
        elif p.startswith("type:"):
            hit = kind == p[5:]
        elif p.startswith("domain:"):
            d = p[7:].lower()
            hit = (h == d) | h.endswith("." + d)
        else:
            hit = F.contains(url, F.lit(p))
        has_ttl = hit if r.get("ttl") is not None else F.lit(False)
        m = F.lit(r["mode"])
        mode = F.when(hit, m) if mode is None else mode.when(hit, m)
        v = F.lit(r.get("ttl")).cast("int")
        ttl = F.when(has_ttl, v) if ttl is None else ttl.when(has_ttl, v)
    return mode.otherwise(default_mode), ttl


def cacheable(url: Column) -> Column:
    return U.url_kind(url).isin("web_https", "web_http", "local_file")


def hook_matches(event: Column, tags: Column, enabled: bool, events: list[str], hook_tags: list[str]) -> Column:
    ok = F.lit(bool(enabled))
    if events:
        ok = ok & event.isin(events)
    if hook_tags:
        ok = ok & F.arrays_overlap(tags, F.array(*[F.lit(x) for x in hook_tags]))
    return ok


# Bulky payload fields replaced by counts, and fields left out.
COUNTED = ("results", "scraped_content", "extracted_data")


def over(size: Column, limit: int) -> Column:
    """What a limit would cut away."""
    return F.greatest(size - limit, F.lit(0)).cast("long")


def shrink_payload(fields: dict[str, Column], kinds: dict[str, str], max_bytes: int | None = None, chars: int = 1000, items: int = 10) -> Column:
    """JSON payload: lists named above become <name>_count, errors/progress are dropped. Only if a size is given, a payload
    over it (a service took a million bytes) gets texts of `chars` characters and lists of `items`."""
    keep = {}
    for name, c in fields.items():
        if name in ("errors", "progress"):
            continue
        keep[name + "_count" if name in COUNTED else name] = F.size(c) if name in COUNTED else c
    full = F.to_json(F.struct(*[c.alias(n) for n, c in keep.items()]))
    if max_bytes is None:
        return full
    cut = {}
    for n, c in keep.items():
        k = kinds.get(n)
        cut[n] = (F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("..."))).otherwise(c)
                  if k == "text" else F.slice(c, 1, items) if k == "list" else c)
    small = F.to_json(F.struct(*[c.alias(n) for n, c in cut.items()]))
    return F.when(F.octet_length(full) > max_bytes, small).otherwise(full)


# User agent patterns, first hit wins.
BROWSERS = (("Chrome", r"Chrome/(\d+\.\d+)"), ("Firefox", r"Firefox/(\d+\.\d+)"),
            ("Safari", r"Version/(\d+\.\d+).*Safari"), ("Edge", r"Edg/(\d+\.\d+)"), ("Opera", r"OPR/(\d+\.\d+)"),
            ("Internet Explorer", r"MSIE (\d+\.\d+)"))
SYSTEMS = (("Windows", r"Windows NT (\d+\.\d+)"), ("Mac OS", r"Mac OS X (\d+[_\d]*)"), ("Linux", r"Linux"),
           ("Android", r"Android (\d+\.\d+)"), ("iOS", r"iPhone OS (\d+[_\d]*)"))
PLATFORMS = (("Desktop", r"(Windows|Mac OS X|Linux)"), ("Mobile", r"(Android|iPhone|iPad)"),
             ("Tablet", r"(iPad|Android.*Tablet)"))
LAYOUT_ENGINES = (("WebKit", r"WebKit/(\d+\.\d+)"), ("Gecko", r"Gecko/(\d+)"), ("Blink", r"Chrome.*WebKit"),
                  ("EdgeHTML", r"Edge/(\d+\.\d+)"))


def first_hit(c: Column, table, default: str = "Unknown") -> Column:
    out = F.lit(default)
    for name, pattern in reversed(table):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def parse_agent(ua: Column) -> Column:
    version = F.lit("0.0")
    for _, pattern in reversed(BROWSERS):
        version = F.when(ua.rlike(pattern), F.regexp_extract(ua, pattern, 1)).otherwise(version)
    return F.struct(first_hit(ua, BROWSERS).alias("browser"), version.alias("version"),
                    first_hit(ua, PLATFORMS).alias("platform"), first_hit(ua, SYSTEMS).alias("os"),
                    first_hit(ua, LAYOUT_ENGINES).alias("engine"))
