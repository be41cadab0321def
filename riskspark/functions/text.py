"""Column functions for text: whitespace, cleaning, labels, keywords, tokens."""

import json
import sys
import unicodedata
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark import lexicon


def strip_ws(col: Column) -> Column:
    """Trim every kind of Unicode whitespace, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")


def collapse_ws(col: Column) -> Column:
    """Runs of whitespace become one blank; ends are trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", " "))


#: A character reference with its semicolon: decimal, hexadecimal or named.
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def strip_html(col: Column) -> Column:
    """Drop comments, declarations and tags, then decode character references.

    Script and style bodies stay, as a plain text extraction of the tree keeps them.
    """
    return decode_entities(F.regexp_replace(col, r"(?s)<!--.*?-->|<[!?][^>]*>|</?[A-Za-z][^>]*>", " "))


def decode_entities(col: Column) -> Column:
    """Decode numeric references and the named ones of HTML, in one pass; unknown names stay.

    Numbers that are no character give the replacement character.
    """
    names = [n for n in html5 if n.endswith(";")]
    named = F.map_from_arrays(_listed(names), _listed([html5[n] for n in names]))
    found = F.regexp_extract_all(col, F.lit(ENTITY), F.lit(0))
    chars = F.transform(found, lambda e: _decoded(e, named))
    between = F.split(col, ENTITY, -1)
    joined = F.array_join(F.zip_with(between, chars, lambda t, c: F.concat(t, F.coalesce(c, F.lit("")))), "")
    return F.when(col.rlike(ENTITY), joined).otherwise(col)


def _listed(items: list[str]) -> Column:
    """A list of strings as one constant, which the optimizer folds."""
    return F.split(F.lit("\x1f".join(items)), "\x1f")


def _decoded(entity: Column, named: Column) -> Column:
    hexadecimal = F.substr(entity, F.lit(3), F.lit(1)).isin("x", "X")
    digits = F.regexp_replace(entity, "^&#[xX]?|;$", "")
    code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
    wide = F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")
    number = F.decode(F.unhex(wide), "UTF-32")
    name = F.try_element_at(named, F.substr(entity, F.lit(2)))
    return F.when(entity.startswith("&#"), number).otherwise(F.coalesce(name, entity))


def clean_text(col: Column) -> Column:
    """Lower-case, tag-free, single-spaced text over a fixed ASCII alphabet."""
    text = F.coalesce(col, F.lit(""))
    text = F.when(text.contains("<") & text.contains(">"), strip_html(text)).otherwise(text)
    text = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    text = F.regexp_replace(text, r"[^a-z0-9\s.,!?\-_:;/@#$%&*()\[\]{}'\"]+", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def coerce_label(col: Column) -> Column:
    """String label to 0/1: known words first, then a number above one half, else 0."""
    word = strip_ws(F.lower(col.cast("string")))
    number = word.try_cast("double")
    return (
        F.when(word.isin(lexicon.POSITIVE_LABELS), 1)
        .when(word.isin(lexicon.NEGATIVE_LABELS), 0)
        .when(number.isNotNull() & ~F.isnan(number) & (number > 0.5), 1)
        .otherwise(0)
    )


def constant_words(words: list[str]) -> Column:
    """A word list as one constant: the optimizer folds the split away."""
    return F.split(F.lit("\n".join(words)), "\n")


def keyword_hits(haystack: Column, words: list[str]) -> Column:
    """The words contained in `haystack`, in list order. Null text has no hits."""
    found = F.filter(constant_words(words), lambda w: F.contains(haystack, w))
    return F.coalesce(found, F.array().cast("array<string>"))


def pattern_hits(haystack: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur at least once."""
    hits = [F.when(haystack.rlike("(?U)" + p), 1).otherwise(0) for p in patterns]
    return sum(hits[1:], hits[0])


def shown(words: Column, n: int) -> Column:
    return F.array_join(F.slice(words, 1, n), ", ")


def capped(points: Column, limit: int) -> Column:
    return F.least(points, F.lit(limit))


def checks_array(*items: tuple) -> Column:
    """Array of {name, status, detail} for the items (condition, name, status, detail)
    whose condition holds, in order.

    Conditions and details are two flat arrays and names are constants: this keeps the
    generated code far below the size limits that a struct per case would exceed.
    """
    conditions = F.array(*[F.coalesce(c, F.lit(False)) for c, *_ in items])
    details = F.array(
        *[F.lit(d) if isinstance(d, str) else F.when(c, d) for c, _, _, d in items]
    )
    names = json.dumps([{"name": n, "status": s} for _, n, s, _ in items])
    named = F.from_json(F.lit(names), "array<struct<name:string,status:string>>")
    pairs = F.arrays_zip(conditions.alias("holds"), named.alias("of"), details.alias("detail"))
    return F.transform(
        F.filter(pairs, lambda x: x["holds"]),
        lambda x: F.struct(
            x["of"]["name"].alias("name"), x["of"]["status"].alias("status"), x["detail"].alias("detail")
        ),
    )


def _accent_pairs() -> tuple[str, str]:
    """Single letters whose compatibility decomposition is one base letter plus marks."""
    source, target = [], []
    for code in range(0xC0, min(sys.maxunicode, 0xFFFF)):
        char = chr(code)
        base = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if len(base) == 1 and base != char and base.isalnum():
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def strip_accents(col: Column) -> Column:
    source, target = _accent_pairs()
    plain = F.regexp_replace(F.translate(col, source, target), r"\p{Mn}+", "")
    return F.when(col.rlike(r"[^\x00-\x7F]"), plain).otherwise(col)


def words(col: Column, stop_words=None) -> Column:
    """Words of two or more word characters, lower-case, without accents or stop words."""
    stop_words = lexicon.STOP_WORDS if stop_words is None else list(stop_words)
    text = strip_accents(F.lower(F.coalesce(col, F.lit(""))))
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(stop_words)) if stop_words else found


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams of the remaining words, shorter first; they bridge removed words."""
    grams = [_of_length(tokens, n) for n in range(low, high + 1)]
    return grams[0] if len(grams) == 1 else F.concat(*grams)


def _of_length(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    # Zip the word list with itself shifted by one place per position: linear in the text.
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    joined = F.slice(tokens, F.lit(1), count)
    for shift in range(1, n):
        joined = F.zip_with(
            joined,
            F.slice(tokens, F.lit(1 + shift), count),
            lambda left, right: F.concat(left, F.lit(" "), right),
        )
    return joined
