"""URL queries and their SQL checks."""

from pyspark.sql import functions as F

from riskspark import lexicon
from riskspark.functions import urls as fn
from riskspark.operators import urls
from riskspark.plans.scans import score_urls
from suite.registry import query
from suite.views import cte, listed, quoted

URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
PAIRS = ", ".join(
    f"{{'b': {quoted(b)}, 'v': {quoted(v)}}}"
    for b, variants in lexicon.BRAND_VARIANTS.items()
    for v in variants
)


def chars(col: str, found: str) -> str:
    return f"length({col}) - length(translate({col}, {quoted(found)}, ''))"


def hits(text: str, words) -> str:
    return f"[k FOR k IN {listed(words)} IF contains({text}, k)]"


def url_ctes(source: str, keep: str = "id", prefix: bool = True) -> str:
    """CTEs p (parts), f (features), s (scores) over `source`(keep..., url)."""
    absolute = (
        "CASE WHEN contains(url, '://') THEN url ELSE 'http://' || url END" if prefix else "url"
    )
    return rf"""
p0 AS (SELECT {keep}, url, regexp_replace(translate({absolute}, chr(9) || chr(10) || chr(13), ''), '^[\x00-\x20]+', '') AS n FROM {source}),
p1 AS (SELECT *, lower(regexp_extract(n, '{URI}', 1)) AS scheme, regexp_extract(n, '{URI}', 2) AS auth,
  regexp_extract(n, '{URI}', 3) AS path0, regexp_extract(n, '{URI}', 4) AS query FROM p0),
p2 AS (SELECT *, CASE WHEN contains(auth, '@') THEN string_split(auth, '@')[-1] ELSE auth END AS hp FROM p1),
p3 AS (SELECT *, contains(hp, '[') AS br,
  lower(CASE WHEN contains(hp, '[') THEN regexp_extract(hp, '\[([^\]]*)', 1) ELSE split_part(hp, ':', 1) END) AS host,
  CASE WHEN contains(hp, '[') THEN regexp_extract(hp, '\][^:]*:(.*)$', 1) ELSE regexp_extract(hp, '^[^:]*:(.*)$', 1) END AS pt,
  CASE WHEN list_contains({listed(fn.PARAM_SCHEMES)}, scheme) THEN regexp_replace(path0, ';[^/]*$', '') ELSE path0 END AS path
  FROM p2),
p4 AS (SELECT *, (contains(auth, '[') <> contains(auth, ']')) OR (br AND NOT regexp_matches(hp, '^\[[0-9a-fA-F:.]*:[0-9a-fA-F:.]*\](:.*)?$')) AS badbr,
  pt <> '' AND NOT (regexp_full_match(pt, '[0-9]+') AND coalesce(try_cast(pt AS HUGEINT), 99999) <= 65535) AS badport FROM p3),
p AS (SELECT *, CASE WHEN badport OR pt = '' THEN NULL ELSE pt::BIGINT END AS port,
  CASE WHEN badbr THEN 'Invalid URL' WHEN badport THEN 'Invalid port' END AS error FROM p4),
f0 AS (SELECT *, string_split(host, '.') AS labels, list_distinct(string_split(host, '')) AS hc FROM p),
f1 AS (SELECT *, CASE WHEN contains(host, '.') THEN '.' || labels[-1] ELSE '' END AS tld,
  CASE WHEN host = '' THEN 0.0::DOUBLE ELSE round(0.0::DOUBLE - list_sum([((length(host) - length(replace(host, x, '')))::DOUBLE / length(host)) * log2((length(host) - length(replace(host, x, '')))::DOUBLE / length(host)) FOR x IN hc]), 10) END AS entropy,
  [t.b FOR t IN [{PAIRS}] IF contains(host, t.v) AND NOT contains(host, t.b)][1] AS brand,
  {hits("lower(url)", lexicon.URL_KEYWORDS)} AS keywords FROM f0),
f AS (SELECT *, length(url) AS url_length, length(url) - length(replace(url, '.', '')) AS dot_count,
  {chars("url", lexicon.SPECIAL_CHARS)} AS special_char_count, contains(url, '@') AS has_at_symbol,
  regexp_full_match(host, '\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}') AS ip_hostname, scheme = 'https' AS uses_https,
  greatest(len(labels) - 2, 0)::BIGINT AS subdomain_depth, length(path) AS path_length,
  list_contains({listed(lexicon.SUSPICIOUS_TLDS)}, tld) AS suspicious_tld,
  list_contains({listed(lexicon.URL_SHORTENERS)}, host) AS url_shortener,
  round_even(entropy, 2)::DOUBLE AS hostname_entropy, brand IS NOT NULL AS typosquatting,
  len(keywords)::BIGINT AS keyword_count, length(host) - length(replace(host, '-', '')) AS hyphen_count,
  port IS NOT NULL AND port NOT IN (80, 443) AS unusual_port, contains(path, '//') AS double_slash_path,
  len({hits("lower(query)", lexicon.SUSPICIOUS_PARAMS)}) > 0 AS suspicious_params FROM f1),
s AS (SELECT *, least(100, CASE WHEN url_length > 75 THEN 8 WHEN url_length > 54 THEN 4 ELSE 0 END
    + 20 * ip_hostname::INT + 10 * (NOT uses_https)::INT + 15 * suspicious_tld::INT + 8 * url_shortener::INT
    + 25 * typosquatting::INT + 10 * (entropy > 3.5)::INT + 10 * (subdomain_depth > 2)::INT
    + least(5 * keyword_count, 15) + 12 * has_at_symbol::INT + least(3 * special_char_count, 10)
    + 5 * (hyphen_count > 2)::INT + 8 * unusual_port::INT + 8 * suspicious_params::INT)::BIGINT AS rule_score,
  least(100, 25 * ip_hostname::INT + 12 * (NOT uses_https)::INT + 18 * suspicious_tld::INT + 30 * typosquatting::INT
    + 12 * (hostname_entropy > 3.5)::INT + 10 * (url_length > 75)::INT + 10 * (subdomain_depth > 2)::INT
    + 12 * (keyword_count >= 2)::INT + 8 * url_shortener::INT + 15 * has_at_symbol::INT)::BIGINT AS ml_score,
  concat_ws(';',
    CASE WHEN url_length > 75 THEN 'Excessive URL Length|fail|' || url_length || ' characters (suspicious > 75)' ELSE 'URL Length|pass|' || url_length || ' characters (normal)' END,
    CASE WHEN dot_count > 4 THEN 'Excessive Dots|fail|' || dot_count || ' dots found' END,
    CASE WHEN special_char_count > 2 THEN 'Special Characters|fail|' || special_char_count || ' suspicious characters' END,
    CASE WHEN has_at_symbol THEN '@ Symbol in URL|fail|URL contains @ symbol (redirect trick)' END,
    CASE WHEN ip_hostname THEN 'IP-based Hostname|fail|Uses IP address instead of domain name' ELSE 'IP-based Hostname|pass|Uses domain name' END,
    CASE WHEN uses_https THEN 'HTTPS Protocol|pass|Secure connection' ELSE 'HTTPS Protocol|fail|No HTTPS - insecure connection' END,
    CASE WHEN subdomain_depth > 2 THEN 'Deep Subdomains|fail|' || subdomain_depth || ' subdomain levels' END,
    CASE WHEN path_length > 50 THEN 'Long Path|fail|' || path_length || ' characters in path' END,
    CASE WHEN suspicious_tld THEN 'Suspicious TLD|fail|TLD "' || tld || '" is commonly used in phishing' ELSE 'TLD Check|pass|TLD "' || tld || '" is standard' END,
    CASE WHEN url_shortener THEN 'URL Shortener|warn|Shortened URL hides true destination' END,
    CASE WHEN entropy > 3.5 THEN 'High Entropy Hostname|fail|Entropy: ' || printf('%.2f', hostname_entropy) || ' (random-looking domain)' END,
    CASE WHEN typosquatting THEN 'Typosquatting Detected|fail|Impersonating "' || brand || '"' END,
    CASE WHEN keyword_count >= 2 THEN 'Suspicious Keywords|fail|Found: ' || array_to_string(keywords[1:5], ', ') END,
    CASE WHEN hyphen_count > 2 THEN 'Excessive Hyphens|fail|' || hyphen_count || ' hyphens in domain' END,
    CASE WHEN unusual_port THEN 'Unusual Port|fail|Port ' || port || ' (non-standard)' END,
    CASE WHEN double_slash_path THEN 'Double Slash in Path|warn|Redirect trick detected' END,
    CASE WHEN suspicious_params THEN 'Suspicious Parameters|fail|Query contains sensitive parameter names' END) AS checks
  FROM f)"""


def from_urls(columns: str, table: str, source: str = "v_urls") -> str:
    return f"WITH {cte('v_urls')}, {url_ctes(source)} SELECT {columns} FROM {table}"


URL = cte("v_urls")


@query("url_parts", from_urls("id, scheme, host, port, path, query, error", "p"))
def _(t):
    return urls.url_parts(t.view("v_urls")).drop("url")


SHAPES = (
    r"regexp_full_match(u, '(?i)(https?://)?[a-zA-Z0-9\-.]+(\.[a-zA-Z]{2,})(/.*)?')",
    r"regexp_full_match(u, '(https?://)?\d{1,3}(\.\d{1,3}){3}(/.*)?')",
)


@query(
    "url_validation",
    f"""WITH {URL}, c AS (SELECT id, regexp_replace(url, '^\\s+|\\s+$', '', 'g') AS u FROM v_urls)
    SELECT id, u AS url, CASE WHEN u = '' THEN 'URL is required' WHEN NOT {SHAPES[0]} AND NOT {SHAPES[1]} THEN 'Invalid URL format' END AS reject_reason FROM c""",
)
def _(t):
    return urls.validate_urls(t.view("v_urls"))


@query(
    "url_lengths_counts",
    from_urls("id, url_length, dot_count, path_length, hyphen_count, special_char_count", "f"),
)
def _(t):
    return urls.url_rule_features(t.view("v_urls")).select(
        "id", "url_length", "dot_count", "path_length", "hyphen_count", "special_char_count"
    )


FLAGS = "id, has_at_symbol, ip_hostname, uses_https, double_slash_path, unusual_port, suspicious_params"


@query("url_flags", from_urls(FLAGS, "f"))
def _(t):
    return urls.url_rule_features(t.view("v_urls")).select(*FLAGS.split(", "))


@query("url_subdomain_depth", from_urls("id, subdomain_depth", "f"))
def _(t):
    return urls.url_rule_features(t.view("v_urls")).select("id", "subdomain_depth")


@query("url_suspicious_tld", from_urls("id, suspicious_tld", "f"))
def _(t):
    return urls.url_rule_features(t.view("v_urls")).select("id", "suspicious_tld")


@query("url_shortener", from_urls("id, url_shortener", "f"))
def _(t):
    return urls.url_rule_features(t.view("v_urls")).select("id", "url_shortener")


@query("url_entropy", from_urls("id, hostname_entropy", "f"))
def _(t):
    return urls.url_rule_features(t.view("v_urls")).select("id", "hostname_entropy")


@query("url_typosquat", from_urls("id, typosquatting, brand AS typosquat_brand", "f"))
def _(t):
    return urls.url_rule_features(t.view("v_urls")).select("id", "typosquatting", "typosquat_brand")


@query(
    "url_keywords",
    from_urls("id, array_to_string(keywords, ';') AS suspicious_keywords, keyword_count AS n", "f"),
)
def _(t):
    return urls.url_rule_features(t.view("v_urls")).select(
        "id", "suspicious_keywords", F.size("suspicious_keywords").alias("n")
    )


@query("url_rule_score", from_urls("id, rule_score", "s"))
def _(t):
    return urls.url_rule_score(t.view("v_urls")).select("id", "rule_score")


@query("url_checks", from_urls("id, checks", "s"))
def _(t):
    return urls.url_checks(t.view("v_urls")).select("id", "checks")


CANONICAL = """
c0 AS (SELECT id, url, regexp_replace(lower(url), '^\\s+|\\s+$', '', 'g') AS a FROM v_urls),
c1 AS (SELECT *, CASE WHEN starts_with(a, 'http://') THEN a[8:] ELSE a END AS b FROM c0),
c2 AS (SELECT *, CASE WHEN starts_with(b, 'https://') THEN b[9:] ELSE b END AS c FROM c1),
c AS (SELECT id, url, CASE WHEN starts_with(c, 'www.') THEN c[5:] ELSE c END AS u FROM c2)"""


@query("url_canonical", f"WITH {URL}, {CANONICAL} SELECT id, u AS canonical FROM c")
def _(t):
    return t.view("v_urls").select("id", fn.canonical(F.col("url")).alias("canonical"))


EXACT = [s for s in lexicon.SUFFIXES if s[0] not in "*!"]
WILD = [s[2:] for s in lexicon.SUFFIXES if s.startswith("*.")]
EXCEPT = [s[1:] for s in lexicon.SUFFIXES if s.startswith("!")]


def domain_ctes(source: str, col: str) -> str:
    """CTE d: subdomain, domain, suffix of `col`, by listing all tails of the host."""
    return rf"""
d0 AS (SELECT *, regexp_replace({col}, '^([A-Za-z0-9+.\-]+:)?//', '') AS bare FROM {source}),
d1 AS (SELECT *, regexp_extract(bare, '^[^/?#]*') AS place FROM d0),
d2 AS (SELECT *, regexp_replace(trim(split_part(CASE WHEN contains(place, '@') THEN string_split(place, '@')[-1] ELSE place END, ':', 1)), '\.+$', '') AS loc FROM d1),
d3 AS (SELECT *, string_split(loc, '.') AS ls, (regexp_full_match(loc, '(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){{3}}') OR starts_with(loc, '[')) AS ip FROM d2),
d4 AS (SELECT *, len(ls) AS m, [{{'k': k, 't': lower(array_to_string(ls[len(ls) - k + 1:], '.')), 'up': lower(array_to_string(ls[len(ls) - k + 2:], '.'))}} FOR k IN range(1, len(ls) + 1)] AS tails FROM d3),
d5 AS (SELECT *, CASE WHEN ip THEN 0 ELSE coalesce(
  list_max([x.k - 1 FOR x IN tails IF list_contains({listed(EXCEPT)}, x.t)]),
  list_max([x.k FOR x IN tails IF list_contains({listed(EXACT)}, x.t) OR (x.k > 1 AND list_contains({listed(WILD)}, x.up))]), 0) END AS sk FROM d4),
d AS (SELECT *, CASE WHEN ip OR m - sk < 2 THEN '' ELSE array_to_string(ls[1:m - sk - 1], '.') END AS subdomain,
  CASE WHEN ip THEN loc WHEN m - sk < 1 THEN '' ELSE ls[m - sk] END AS domain,
  CASE WHEN ip OR sk = 0 THEN '' ELSE array_to_string(ls[m - sk + 1:], '.') END AS suffix FROM d5)"""


MODEL = f"""WITH {URL}, {CANONICAL}, {domain_ctes("c", "u")}
SELECT id, length(u) AS url_length, CASE WHEN contains(u, '/') THEN length(u) - strpos(u, '/') + 1 ELSE 0 END::BIGINT AS path_length,
  {", ".join(f"length(u) - length(replace(u, '{c}', '')) AS {n}_count" for c, n in (('.', 'dot'), ('-', 'hyphen'), ('_', 'underscore'), ('/', 'slash'), ('?', 'question'), ('=', 'equal'), ('@', 'at')))},
  {chars("u", "0123456789")} AS digit_count, {chars("u", "abcdefghijklmnopqrstuvwxyz")} AS letter_count,
  round(({chars("u", "0123456789")})::DOUBLE / greatest(length(u), 1), 6)::DOUBLE AS digit_ratio, {chars("u", "aeiou")} AS vowel_count,
  round(({chars("u", "aeiou")})::DOUBLE / greatest(length(u), 1), 6)::DOUBLE AS vowel_ratio,
  regexp_matches(u, '(\\d{{1,3}}\\.){{3}}\\d{{1,3}}')::BIGINT AS has_ip, length(subdomain) AS subdomain_len, length(domain) AS domain_len,
  list_contains({listed(lexicon.MODEL_TLDS)}, lower(suffix))::BIGINT AS sus_tld,
  len(regexp_extract_all(u, '{"|".join(lexicon.MODEL_KEYWORDS)}'))::BIGINT AS sus_keyword_count,
  round(CASE WHEN u = '' THEN 0 ELSE len(list_distinct(string_split(u, ''))) END::DOUBLE / greatest(length(u), 1), 6)::DOUBLE AS char_diversity FROM d"""


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("url_model_features", MODEL)
def _(t):
    df = urls.url_model_features(t.view("v_urls")).drop("url")
    return rounded(df, "digit_ratio", "vowel_ratio", "char_diversity")


@query(
    "url_registrable_domain",
    f"WITH {URL}, {domain_ctes('v_urls', 'url')} SELECT id, subdomain, domain, suffix FROM d",
)
def _(t):
    return urls.registrable_domain(t.view("v_urls"), "url").drop("url")


@query(
    "url_lexical14",
    f"""WITH {URL}, {domain_ctes("v_urls", "url")}
SELECT id, length(url) AS url_length,
  CASE WHEN len(string_split(url, '/')) > 3 THEN length(array_to_string(string_split(url, '/')[4:], '/')) ELSE 0 END::BIGINT AS path_length,
  length(url) - length(replace(url, '.', '')) AS dot_count, length(url) - length(replace(url, '-', '')) AS hyphen_count,
  {chars("url", "0123456789")} AS digit_count, {chars("url", lexicon.SPECIAL_CHARS)} AS special_chars,
  contains(url, '@')::BIGINT AS at_symbol, contains(lower(url), 'https://')::BIGINT AS has_https,
  regexp_matches(url, '(\\d{{1,3}}\\.){{3}}\\d{{1,3}}')::BIGINT AS has_ip, length(subdomain) AS subdomain_len, length(domain) AS domain_len,
  list_contains({listed(lexicon.LEXICAL_TLDS)}, lower(suffix))::BIGINT AS sus_tld,
  regexp_matches(lower(url), '{"|".join(lexicon.LEXICAL_KEYWORDS)}')::BIGINT AS has_sus_keyword,
  round(CASE WHEN url = '' THEN 0 ELSE len(list_distinct(string_split(url, ''))) END::DOUBLE / greatest(length(url), 1), 6)::DOUBLE AS char_diversity FROM d""",
)
def _(t):
    return rounded(urls.url_lexical14(t.view("v_urls")).drop("url"), "char_diversity")


BASIC = [
    "length(url)", "length(url) - length(replace(url, '.', ''))",
    "length(url) - length(replace(url, '-', ''))", chars("url", "0123456789"),
    chars("url", lexicon.BASIC_SPECIAL_CHARS), "contains(url, 'https')::BIGINT",
    "length(subdomain)", "length(path)", "contains(url, '@')::BIGINT",
    "regexp_matches(url, '(\\d{1,3}\\.){3}\\d{1,3}')::BIGINT",
]


@query(
    "url_basic10",
    f"WITH {URL}, {url_ctes('v_urls', prefix=False)}, {domain_ctes('p', 'url')} SELECT id, "
    + ", ".join(
        f"CASE WHEN badbr THEN 0 ELSE {e} END::BIGINT AS {n}" for e, n in zip(BASIC, urls.BASIC_FEATURES)
    )
    + " FROM d",
)
def _(t):
    return urls.url_basic10(t.view("v_urls")).drop("url")


@query(
    "url_well_known",
    f"""WITH {URL}, {url_ctes("v_urls")}, {domain_ctes("p", "url")}
SELECT id, NOT badbr AND (list_contains({listed(lexicon.WELL_KNOWN_DOMAINS)}, host) OR list_contains({listed(lexicon.WELL_KNOWN_DOMAINS)}, lower(domain || '.' || suffix))) AS well_known FROM d""",
)
def _(t):
    return urls.flag_well_known(t.view("v_urls")).select("id", "well_known")


@query("url_heuristic_score", from_urls("id, ml_score, round(least(ml_score / 100.0, 0.99), 6)::DOUBLE AS ml_probability", "s"))
def _(t):
    df = urls.url_heuristic_score(t.view("v_urls")).select("id", "ml_score", "ml_probability")
    return rounded(df, "ml_probability")


@query("url_error_rows", from_urls("id, url, error", "p") + " WHERE error IS NOT NULL")
def _(t):
    return urls.url_parts(t.view("v_urls")).filter("error IS NOT NULL").select("id", "url", "error")


URL_SCANS = """id, 'url' AS scan_type, left(CASE WHEN host <> '' THEN host ELSE left(url, 50) END, 255) AS scan_summary,
  CASE WHEN error IS NOT NULL THEN 0.0 ELSE (rule_score + ml_score) / 2.0 END::DOUBLE AS risk_score,
  CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN rule_score + ml_score >= 132 THEN 'PHISHING' WHEN rule_score + ml_score >= 62 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict,
  rule_score::DOUBLE AS rule_based, ml_score::DOUBLE AS ml_prediction, checks"""


@query("url_scans", from_urls(URL_SCANS, "s"))
def _(t):
    return score_urls(t.view("v_urls")).select(
        "id", "scan_type", "scan_summary", "risk_score", "verdict",
        "details.layer_scores.rule_based", "details.layer_scores.ml_prediction", "details.checks",
    )
