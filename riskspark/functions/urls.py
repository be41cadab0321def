"""URL parsing, features, rule points and checks as plain column expressions.

Each step is a function `step(get) -> {name: Column}` where `get(name)` yields an
earlier value. The same steps therefore run over top-level columns (`on_columns`,
code-generated) and inside an array of links (`on_array`, no shuffle of the message).
"""

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import lexicon
from riskspark.functions.text import (
    capped, checks_array, constant_words, keyword_hits, shown, strip_ws,
)

Get = Callable[[str], Column]

# Schemes whose last path segment may carry `;parameters`.
PARAM_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "sip", "sips",
    "mms", "sftp", "tel",
]
IPV4_SHAPE = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\z"
IP_ANYWHERE = r"(?:\d{1,3}\.){3}\d{1,3}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
ENTROPY_LIMIT = 3.5


def on_columns(df: DataFrame, steps, *drop: str) -> DataFrame:
    for step in steps:
        df = df.withColumns(step(F.col))
    return df.drop(*drop)


def on_array(urls: Column, steps, keep: list[str]) -> Column:
    """Run the steps on every element of an array of URLs; keep the named fields."""
    fields = ["url"]
    rows = F.transform(urls, lambda u: F.struct(u.alias("url")))
    for step in steps:
        rows = F.transform(rows, _extender(step, fields))
    return F.transform(rows, lambda row: F.struct(*[row[f].alias(f) for f in keep]))


def _extender(step, fields: list[str]):
    """Lambda that adds the values of a step to a row; `fields` grows by their names."""

    def extend(row: Column) -> Column:
        new = step(lambda name: row[name])
        fields.extend(n for n in new if n not in fields)
        return F.struct(*[(new[f] if f in new else row[f]).alias(f) for f in fields])

    return extend


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def count_any(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


# -- parts ------------------------------------------------------------------


def with_scheme(get: Get) -> dict[str, Column]:
    url = F.coalesce(get("url"), F.lit(""))
    return {"url": url} | _absolute(F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url)))


def as_given(get: Get) -> dict[str, Column]:
    return _absolute(F.coalesce(get("url"), F.lit("")))


def _absolute(text: Column) -> dict[str, Column]:
    text = F.translate(text, "\t\r\n", "")
    return {"_abs": F.ltrim(text, F.lit("".join(chr(c) for c in range(0x21))))}


# The parts follow RFC 3986 with plain string functions: the first `#` starts the fragment,
# the first `?` before it the query, and an authority sits between `//` and the next `/`.


def split_query(get: Get) -> dict[str, Column]:
    text = F.substring_index(get("_abs"), "#", 1)
    front = F.substring_index(text, "?", 1)
    return {"_front": front, "query": _after(text, front)}


def split_scheme(get: Get) -> dict[str, Column]:
    return {"_scheme": F.regexp_extract(get("_front"), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)}


def split_path(get: Get) -> dict[str, Column]:
    front, scheme = get("_front"), get("_scheme")
    rest = F.when(scheme == "", front).otherwise(_after(front, scheme))
    slashes = rest.startswith("//")
    authority = F.when(slashes, F.substring_index(F.substr(rest, F.lit(3)), "/", 1)).otherwise("")
    return {
        "scheme": F.lower(scheme),
        "_authority": authority,
        "_path": F.when(slashes, F.substr(rest, F.length(authority) + 3)).otherwise(rest),
    }


def _after(text: Column, front: Column) -> Column:
    """What follows `front` and one separator at the start of `text`."""
    return F.substr(text, F.length(front) + 2)


def split_authority(get: Get) -> dict[str, Column]:
    authority, path = get("_authority"), get("_path")
    hostport = F.substring_index(authority, "@", -1)
    bracketed = hostport.contains("[")
    plain = F.substring_index(hostport, ":", 1)
    host = F.when(bracketed, F.regexp_extract(hostport, r"\[([^\]]*)", 1)).otherwise(plain)
    port = F.when(bracketed, F.regexp_extract(hostport, r"\][^:]*:(.*)\z", 1)).otherwise(
        _after(hostport, plain)
    )
    bad_bracket = (authority.contains("[") != authority.contains("]")) | (
        bracketed
        & ~hostport.rlike(r"(?i)^\[(?:v[0-9a-f]+\..+|[0-9a-f.]*:[0-9a-f.]*:[0-9a-f:.]*(?:%.*)?)\](?::|\z)")
    )
    number = port.try_cast("int")
    bad_port = (port != "") & (
        ~port.rlike(r"^[0-9]+\z") | number.isNull() | (number > 65535)
    )
    parameters = path.contains(";") & get("scheme").isin(PARAM_SCHEMES)
    return {
        "host": F.lower(host),
        "port": F.when(bad_port, None).otherwise(number),
        "path": F.when(parameters, F.regexp_replace(path, r";[^/]*\z", "")).otherwise(path),
        "bad_bracket": bad_bracket,
        "error": F.when(bad_bracket, "Invalid URL").when(bad_port, "Invalid port"),
    }


PARTS = [with_scheme, split_query, split_scheme, split_path, split_authority]
RAW_PARTS = [as_given, *PARTS[1:]]


# -- rule features ----------------------------------------------------------


def entropy_bits(text: Column) -> Column:
    """Shannon entropy per character. Ten decimals keep exact limits exact.

    Sorting the characters turns every letter into one run, whose length is its count.
    """
    n = F.length(text)
    ordered = F.array_join(F.array_sort(F.split(text, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), F.lit(0))
    weighted = F.aggregate(
        runs, F.lit(0.0), lambda acc, run: acc + F.length(run) * F.log2(F.length(run))
    )
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.log2(n) - weighted / n, 10))


def rule_features(get: Get) -> dict[str, Column]:
    url, host, path = get("url"), get("host"), get("path")
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return {
        "_lower": F.lower(url),
        "url_length": F.length(url),
        "dot_count": count_char(url, "."),
        "special_char_count": count_any(url, lexicon.SPECIAL_CHARS),
        "has_at_symbol": url.contains("@"),
        "ip_hostname": host.rlike(IPV4_SHAPE),
        "uses_https": get("scheme") == "https",
        "subdomain_depth": F.greatest(labels - 2, F.lit(0)),
        "path_length": F.length(path),
        "tld": F.when(
            host.contains("."), F.concat(F.lit("."), F.substring_index(host, ".", -1))
        ).otherwise(""),
        "url_shortener": host.isin(lexicon.URL_SHORTENERS),
        "entropy": entropy_bits(host),
        "hyphen_count": count_char(host, "-"),
        "unusual_port": get("port").isNotNull() & ~get("port").isin(80, 443),
        "double_slash_path": path.contains("//"),
        "_query_lower": F.lower(get("query")),
        "typosquat_brand": typosquat_brand(host),
    }


def typosquat_brand(host: Column) -> Column:
    """First brand, in list order, with a variant in the host and without its own name."""
    pairs = [(b, v) for b, variants in lexicon.BRAND_VARIANTS.items() for v in variants]
    rows = json.dumps([{"brand": b, "variant": v} for b, v in pairs])
    table = F.from_json(F.lit(rows), "array<struct<brand:string,variant:string>>")
    hits = F.filter(
        table,
        lambda t: F.contains(host, t["variant"]) & ~F.contains(host, t["brand"]),
    )
    # Most hosts hold no variant at all: the plain string test spares them the table.
    some = F.exists(constant_words([v for _, v in pairs]), lambda v: F.contains(host, v))
    return F.when(some, F.try_element_at(hits, F.lit(1))["brand"])


def rule_flags(get: Get) -> dict[str, Column]:
    hits = keyword_hits(get("_query_lower"), lexicon.SUSPICIOUS_PARAMS)
    return {
        "suspicious_tld": get("tld").isin(lexicon.SUSPICIOUS_TLDS),
        "hostname_entropy": F.bround(get("entropy"), 2),
        "high_entropy": get("entropy") > ENTROPY_LIMIT,
        "typosquatting": get("typosquat_brand").isNotNull(),
        "suspicious_keywords": keyword_hits(get("_lower"), lexicon.URL_KEYWORDS),
        "suspicious_params": F.size(hits) > 0,
    }


def points(flag: Column, value: int) -> Column:
    return F.when(flag, value).otherwise(0)


def rule_score(get: Get) -> dict[str, Column]:
    length = get("url_length")
    parts = [
        F.when(length > 75, 8).when(length > 54, 4).otherwise(0),
        points(get("ip_hostname"), 20),
        points(~get("uses_https"), 10),
        points(get("suspicious_tld"), 15),
        points(get("url_shortener"), 8),
        points(get("typosquatting"), 25),
        points(get("high_entropy"), 10),
        points(get("subdomain_depth") > 2, 10),
        capped(F.size(get("suspicious_keywords")) * 5, 15),
        points(get("has_at_symbol"), 12),
        capped(get("special_char_count") * 3, 10),
        points(get("hyphen_count") > 2, 5),
        points(get("unusual_port"), 8),
        points(get("suspicious_params"), 8),
    ]
    return {"rule_score": capped(sum(parts[1:], parts[0]), 100)}


def heuristic_score(get: Get) -> dict[str, Column]:
    """Score used when no trained model is given; reads the rounded entropy."""
    parts = [
        points(get("ip_hostname"), 25),
        points(~get("uses_https"), 12),
        points(get("suspicious_tld"), 18),
        points(get("typosquatting"), 30),
        points(get("hostname_entropy") > ENTROPY_LIMIT, 12),
        points(get("url_length") > 75, 10),
        points(get("subdomain_depth") > 2, 10),
        points(F.size(get("suspicious_keywords")) >= 2, 12),
        points(get("url_shortener"), 8),
        points(get("has_at_symbol"), 15),
    ]
    score = capped(sum(parts[1:], parts[0]), 100)
    return {"ml_score": score, "ml_probability": F.least(score / F.lit(100.0), F.lit(0.99))}


def check_rows(get: Get) -> list[tuple]:
    """(condition, name, status, detail) of every check."""

    def number(name: str) -> Column:
        return get(name).cast("string")

    def text(*pieces) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])

    quoted_tld = text('TLD "', get("tld"), '"')
    long, ip, https, tld = (
        get("url_length") > 75, get("ip_hostname"), get("uses_https"), get("suspicious_tld")
    )
    entropy = F.format_string("%.2f", get("hostname_entropy"))
    return [
        (long, "Excessive URL Length", "fail", text(number("url_length"), " characters (suspicious > 75)")),
        (~long, "URL Length", "pass", text(number("url_length"), " characters (normal)")),
        (get("dot_count") > 4, "Excessive Dots", "fail", text(number("dot_count"), " dots found")),
        (
            get("special_char_count") > 2, "Special Characters", "fail",
            text(number("special_char_count"), " suspicious characters"),
        ),
        (get("has_at_symbol"), "@ Symbol in URL", "fail", "URL contains @ symbol (redirect trick)"),
        (ip, "IP-based Hostname", "fail", "Uses IP address instead of domain name"),
        (~ip, "IP-based Hostname", "pass", "Uses domain name"),
        (https, "HTTPS Protocol", "pass", "Secure connection"),
        (~https, "HTTPS Protocol", "fail", "No HTTPS - insecure connection"),
        (
            get("subdomain_depth") > 2, "Deep Subdomains", "fail",
            text(number("subdomain_depth"), " subdomain levels"),
        ),
        (get("path_length") > 50, "Long Path", "fail", text(number("path_length"), " characters in path")),
        (tld, "Suspicious TLD", "fail", text(quoted_tld, " is commonly used in phishing")),
        (~tld, "TLD Check", "pass", text(quoted_tld, " is standard")),
        (get("url_shortener"), "URL Shortener", "warn", "Shortened URL hides true destination"),
        (
            get("high_entropy"), "High Entropy Hostname", "fail",
            text("Entropy: ", entropy, " (random-looking domain)"),
        ),
        (
            get("typosquatting"), "Typosquatting Detected", "fail",
            text('Impersonating "', get("typosquat_brand"), '"'),
        ),
        (
            F.size(get("suspicious_keywords")) >= 2, "Suspicious Keywords", "fail",
            text("Found: ", shown(get("suspicious_keywords"), 5)),
        ),
        (get("hyphen_count") > 2, "Excessive Hyphens", "fail", text(number("hyphen_count"), " hyphens in domain")),
        (get("unusual_port"), "Unusual Port", "fail", text("Port ", number("port"), " (non-standard)")),
        (get("double_slash_path"), "Double Slash in Path", "warn", "Redirect trick detected"),
        (
            get("suspicious_params"), "Suspicious Parameters", "fail",
            "Query contains sensitive parameter names",
        ),
    ]


def checks(get: Get) -> dict[str, Column]:
    return {"checks": checks_array(*check_rows(get))}


RULES = [*PARTS, rule_features, rule_flags]
SCORING = [*RULES, rule_score]


# -- registrable domain and model features ----------------------------------


def canonical(col: Column) -> Column:
    """Lower-case URL without scheme and `www.`; each prefix is removed at most once."""
    text = strip_ws(F.lower(F.coalesce(col, F.lit(""))))
    for prefix in ("http://", "https://", "www."):
        text = F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)
    return text


def netloc(get: Get) -> dict[str, Column]:
    """Lenient network location: scheme optional, user info and port removed."""
    url = get("_domain_of")
    scheme = r"^(?:[A-Za-z0-9+.\-]+:)?//"
    place = F.when(url.contains("//"), F.regexp_replace(url, scheme, "")).otherwise(url)
    for end in "/?#":
        place = F.substring_index(place, end, 1)
    place = F.trim(F.substring_index(F.substring_index(place, "@", -1), ":", 1))
    for dot in "。．｡":
        place = F.replace(place, F.lit(dot), F.lit("."))
    return {"_netloc": F.rtrim(place, F.lit("."))}


def domain_split(suffixes: list[str]):
    """Step that splits `_netloc` into subdomain, domain and public suffix.

    The suffix rules become hash-set membership tests on the last 1..n labels, so the
    split is a narrow expression: no explode, no join, no regrouping.
    """
    exact = [s for s in suffixes if s[0] not in "*!"]
    wild = [s[2:] for s in suffixes if s.startswith("*.")]
    exceptions = [s[1:] for s in suffixes if s.startswith("!")]
    depth = max([s.count(".") + 1 for s in exact + exceptions] + [s.count(".") + 2 for s in wild])

    def step(get: Get) -> dict[str, Column]:
        place = get("_netloc")
        lowered = F.lower(place)
        n = count_char(place, ".") + 1
        tails = {0: F.lit("")}
        tails |= {k: F.substring_index(lowered, ".", -k) for k in range(1, depth + 1)}
        length = F.lit(None).cast("int")
        rules = []
        for k in range(depth, 0, -1):
            if exceptions:
                rules.append(((n >= k) & tails[k].isin(exceptions), k - 1))
        for k in range(depth, 0, -1):
            known = tails[k].isin(exact)
            if wild and k > 1:
                known = known | tails[k - 1].isin(wild)
            rules.append(((n >= k) & known, k))
        for condition, size in reversed(rules):
            length = F.when(condition, size).otherwise(length)
        ip = place.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}\z") | place.startswith("[")
        return {"_labels": n, "_suffix_labels": F.coalesce(length, F.lit(0)), "_ip": ip}

    return step


def split_suffix(get: Get) -> dict[str, Column]:
    place, n, k = get("_netloc"), get("_labels"), get("_suffix_labels")
    suffix = F.call_function("substring_index", place, F.lit("."), -k)
    front = F.substr(place, F.lit(1), F.length(place) - F.length(suffix) - 1)
    return {
        "suffix": F.when(get("_ip") | (k == 0), "").otherwise(suffix),
        "_rest": F.when(get("_ip") | (k == 0), place).when(n <= k, "").otherwise(front),
    }


def domain_parts(get: Get) -> dict[str, Column]:
    rest = get("_rest")
    last = F.substring_index(rest, ".", -1)
    front = F.substr(rest, F.lit(1), F.greatest(F.length(rest) - F.length(last) - 1, F.lit(0)))
    return {
        "subdomain": F.when(get("_ip"), "").otherwise(front),
        "domain": F.when(get("_ip"), rest).otherwise(last),
    }


def diversity(text: Column) -> Column:
    distinct = F.when(text == "", 0).otherwise(F.size(F.array_distinct(F.split(text, ""))))
    return distinct / F.greatest(F.length(text), F.lit(1))


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)
