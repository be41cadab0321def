"""URL operators: table in, table with more columns out. All are narrow projections."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark import lexicon
from riskspark.functions import text, urls
from riskspark.functions.staging import hold

RULE_FEATURES = [
    "url_length", "dot_count", "special_char_count", "has_at_symbol", "ip_hostname",
    "uses_https", "subdomain_depth", "path_length", "suspicious_tld", "url_shortener",
    "hostname_entropy", "typosquatting", "suspicious_keywords", "hyphen_count",
    "unusual_port", "double_slash_path", "suspicious_params",
]
_PART_INTERNALS = ["_abs", "_front", "_scheme", "_authority", "_path", "bad_bracket"]
_RULE_INTERNALS = [*_PART_INTERNALS, "_lower", "_query_lower", "entropy", "high_entropy", "tld"]


def _named(df: DataFrame, col: str) -> DataFrame:
    return df if col == "url" else df.withColumn("url", F.col(col))


def url_parts(df: DataFrame, col: str = "url") -> DataFrame:
    """Add scheme, host, port, path, query and error."""
    parsed = urls.on_columns(_named(df, col), urls.PARTS, *_PART_INTERNALS)
    return hold(parsed, "scheme", "host", "port", "path", "query", "error")


def validate_urls(df: DataFrame, col: str = "url") -> DataFrame:
    """Trim the URL and add `reject_reason`, null when the URL is accepted."""
    # Accepted URL shapes.
    url_shape = r"(?i)^(https?://)?[a-zA-Z0-9\-.]+(\.[a-zA-Z]{2,})(/.*)?$"
    ip_shape = r"^(https?://)?\d{1,3}(\.\d{1,3}){3}(/.*)?$"
    trimmed = text.strip_ws(F.coalesce(F.col(col), F.lit("")))
    return df.withColumn(col, trimmed).withColumn(
        "reject_reason",
        F.when(F.col(col) == "", "URL is required").when(
            ~F.col(col).rlike(url_shape) & ~F.col(col).rlike(ip_shape), "Invalid URL format"
        ),
    )


def split_validated(df: DataFrame, col: str = "url") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows as two tables."""
    marked = validate_urls(df, col)
    accepted = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted, marked.filter(F.col("reject_reason").isNotNull())


def url_rule_features(df: DataFrame, col: str = "url") -> DataFrame:
    """Add the parts and the 17 rule features."""
    return urls.on_columns(_named(df, col), urls.RULES, *_RULE_INTERNALS)


def url_rule_score(df: DataFrame, col: str = "url") -> DataFrame:
    return hold(urls.on_columns(_named(df, col), urls.SCORING, *_RULE_INTERNALS), "rule_score")


def url_checks(df: DataFrame, col: str = "url") -> DataFrame:
    return urls.on_columns(_named(df, col), [*urls.SCORING, urls.checks], *_RULE_INTERNALS)


def url_check_rows() -> list[tuple]:
    """The checks over the columns that `url_check_inputs` adds."""
    return urls.check_rows(F.col)


def url_check_inputs(df: DataFrame, col: str = "url") -> DataFrame:
    return urls.on_columns(_named(df, col), urls.RULES)


def url_heuristic_score(df: DataFrame, col: str = "url") -> DataFrame:
    steps = [*urls.SCORING, urls.heuristic_score]
    return urls.on_columns(_named(df, col), steps, *_RULE_INTERNALS)


def full_url_score(df: DataFrame, col: str = "url") -> DataFrame:
    steps = [*urls.SCORING, urls.heuristic_score]
    scored = hold(
        urls.on_columns(_named(df, col), steps),
        "rule_score", "ml_score", "ml_probability", "host", "error",
    )
    return urls.on_columns(scored, [urls.checks], *_RULE_INTERNALS)


def registrable_domain(df: DataFrame, col: str, suffixes=None) -> DataFrame:
    """Add subdomain, domain and suffix by longest public-suffix match."""
    steps = [
        lambda get: {"_domain_of": get(col)},
        urls.netloc,
        urls.domain_split(suffixes or lexicon.SUFFIXES),
        urls.split_suffix,
        urls.domain_parts,
    ]
    return urls.on_columns(
        df, steps, "_domain_of", "_netloc", "_labels", "_suffix_labels", "_ip", "_rest"
    )


def flag_well_known(df: DataFrame, col: str = "url", suffixes=None) -> DataFrame:
    """Add `well_known`: the host or its registrable domain is on the fixed list."""
    have = "host" in df.columns
    df = df if have else urls.on_columns(_named(df, col), urls.PARTS, *_PART_INTERNALS)
    df = registrable_domain(df, col, suffixes)
    base = F.lower(F.concat(F.col("domain"), F.lit("."), F.col("suffix")))
    known = lexicon.WELL_KNOWN_DOMAINS
    listed = F.col("host").isin(known) | base.isin(known)
    parsed = F.col("error").isNull() | (F.col("error") != "Invalid URL")
    return df.withColumn("well_known", parsed & listed).drop("subdomain", "domain", "suffix")


def url_model_features(df: DataFrame, col: str = "url", suffixes=None) -> DataFrame:
    """Add the 20 model features, computed on the canonical URL."""
    df = df.withColumn("_u", urls.canonical(F.col(col)))
    df = registrable_domain(df, "_u", suffixes)
    u = F.col("_u")
    n = F.length(u)
    safe = F.greatest(n, F.lit(1))
    digits = urls.count_any(u, "0123456789")
    vowels = urls.count_any(u, "aeiou")
    columns = {
        "url_length": n,
        "path_length": F.when(u.contains("/"), n - F.instr(u, "/") + 1).otherwise(0),
        "dot_count": urls.count_char(u, "."),
        "hyphen_count": urls.count_char(u, "-"),
        "underscore_count": urls.count_char(u, "_"),
        "slash_count": urls.count_char(u, "/"),
        "question_count": urls.count_char(u, "?"),
        "equal_count": urls.count_char(u, "="),
        "at_count": urls.count_char(u, "@"),
        "digit_count": digits,
        "letter_count": urls.count_any(u, "abcdefghijklmnopqrstuvwxyz"),
        "digit_ratio": digits / safe,
        "vowel_count": vowels,
        "vowel_ratio": vowels / safe,
        "has_ip": urls.flag(u.rlike(urls.IP_ANYWHERE)),
        "subdomain_len": F.length("subdomain"),
        "domain_len": F.length("domain"),
        "sus_tld": urls.flag(F.lower("suffix").isin(lexicon.MODEL_TLDS)),
        "sus_keyword_count": F.regexp_count(u, F.lit("|".join(lexicon.MODEL_KEYWORDS))),
        "char_diversity": urls.diversity(u),
    }
    return df.withColumns(columns).drop("_u", "subdomain", "domain", "suffix")


def url_lexical14(df: DataFrame, col: str = "url", suffixes=None) -> DataFrame:
    """Add the 14 lexical features, computed on the URL as given."""
    df = registrable_domain(df, col, suffixes)
    u = F.col(col)
    third = F.length(F.substring_index(u, "/", 3)) + 1
    columns = {
        "url_length": F.length(u),
        "path_length": F.when(urls.count_char(u, "/") >= 3, F.length(u) - third).otherwise(0),
        "dot_count": urls.count_char(u, "."),
        "hyphen_count": urls.count_char(u, "-"),
        "digit_count": urls.count_any(u, "0123456789"),
        "special_chars": urls.count_any(u, lexicon.SPECIAL_CHARS),
        "at_symbol": urls.flag(u.contains("@")),
        "has_https": urls.flag(F.lower(u).contains("https://")),
        "has_ip": urls.flag(u.rlike(urls.IP_ANYWHERE)),
        "subdomain_len": F.length("subdomain"),
        "domain_len": F.length("domain"),
        "sus_tld": urls.flag(F.lower("suffix").isin(lexicon.LEXICAL_TLDS)),
        "has_sus_keyword": urls.flag(F.lower(u).rlike("|".join(lexicon.LEXICAL_KEYWORDS))),
        "char_diversity": urls.diversity(u),
    }
    return df.withColumns(columns).drop("subdomain", "domain", "suffix")


BASIC_FEATURES = [
    "length", "dots", "hyphens", "digits", "specials", "https", "subdomain_length",
    "path_chars", "at_sign", "ip",
]


def url_basic10(df: DataFrame, col: str = "url", suffixes=None) -> DataFrame:
    """Add the ten basic features; a URL that cannot be parsed gets ten zeros."""
    keep = df.columns
    parsed = urls.on_columns(_named(df, col), urls.RAW_PARTS)
    parsed = registrable_domain(parsed, col, suffixes)
    u = F.col(col)
    values = [
        F.length(u),
        urls.count_char(u, "."),
        urls.count_char(u, "-"),
        urls.count_any(u, "0123456789"),
        urls.count_any(u, lexicon.BASIC_SPECIAL_CHARS),
        urls.flag(u.contains("https")),
        F.length("subdomain"),
        F.length("path"),
        urls.flag(u.contains("@")),
        urls.flag(u.rlike(urls.IP_ANYWHERE)),
    ]
    broken = u.isNull() | F.col("bad_bracket")
    return parsed.select(
        *keep,
        *[F.when(broken, 0).otherwise(v).alias(n) for n, v in zip(BASIC_FEATURES, values)],
    )
