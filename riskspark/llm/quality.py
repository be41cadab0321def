"""Line-first quality rules.

Every line is judged on its own: too many punctuation runs, a line of dividing marks, a line that
consists of navigation entries, a short line with a licence phrase, or a repeat of an earlier line of
the document. Phrases count as whole words. Failing lines go; a document that loses too much of its text
goes as a whole, and so does one that fails the base rules.

Base rules, over words `[^\\x20\\x09-\\x0D]+` of the whole text: fewer than `min_words` words, or over
half of the words lie in three-word windows that occur at least twice.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; a line
without a word is neither failing nor a repeat; equal rows are judged alike; an empty table gives
an empty result; other columns pass through `clean_documents` unchanged, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.common import register, slices, table

MIN_WORDS = 50
MAX_LOST = 30  # percent of a document's word characters
MARKS = re.compile(r"[!*$%&#|<>=~^]{2}|^[|<>»•·]$")  # a run of marks, or a separator alone
RULE = re.compile(r"(?:[-._=*~+#•·][\x20\x09-\x0D]*){3,}")  # a line of marks that divides
LEGAL = re.compile(r"\b(?:all rights reserved|licensed under|released under)\b", re.ASCII)
LEGAL_WORDS = 15  # longer lines are prose that happens to hold such a phrase
NAV_ITEM = (
    r"(?:home|menu|search|help|faq|news|shop|about(?: us)?|contact(?: us)?|site ?map|sign (?:in|up|out)|log ?(?:in|out)"
    r"|register|subscribe(?: now)?|click here|read more|back to top|skip to (?:main )?content|privacy policy"
    r"|cookie policy|terms of (?:use|service)|(?:please )?enable javascript)"
)
NAV_GAP = r"[\x20\x09-\x0D|>»•·/,.:;!?()-]"
NAV = re.compile(f"{NAV_GAP}*{NAV_ITEM}(?:{NAV_GAP}+{NAV_ITEM})*{NAV_GAP}*")
SYMBOLS = re.compile(r"[#*$%&|<>]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "\x20\t\n\v\f\r"

COLUMNS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("lost_chars", T.LongType())]
    + [T.StructField("kept", T.BooleanType()), T.StructField("cleaned", T.StringType())]
)


def repeated_words(words: list[str]) -> int:
    """How many words lie in a three-word window that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, total, after = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, after)
            after = i + 3
    return total


def line_fails(line: str, words: list[str], max_marked: float = 1 / 3) -> bool:
    if sum(1 for w in words if MARKS.search(w)) > max_marked * len(words):
        return True
    low = line.lower()
    if RULE.fullmatch(low.strip(SPACE)) or NAV.fullmatch(low):
        return True
    return len(words) <= LEGAL_WORDS and LEGAL.search(low) is not None


def judge(text: str | None, min_words: int = MIN_WORDS, max_lost: int = MAX_LOST) -> tuple:
    """The values of COLUMNS for one text."""
    text = text or ""
    words = WORDS.findall(text)
    chars = sum(map(len, words))
    repeats, lost, seen, left = 0, 0, set(), []
    for line in text.split("\n"):
        own = WORDS.findall(line)
        again = bool(own) and line in seen
        repeats += again
        if again or (own and line_fails(line, own)):
            lost += sum(map(len, own))
        else:
            left.append(line)
        seen.add(line)
    windows = repeated_words(words)
    failed = len(words) < min_words or 100 * windows > 50 * len(words)
    kept = not failed and 100 * lost <= max_lost * chars
    symbols = len(SYMBOLS.findall(text))
    return len(words), chars, symbols, repeats, windows, failed, lost, kept, "\n".join(left)


def with_quality(docs: DataFrame, keep: list[str], with_text: bool = False) -> DataFrame:
    """The named columns of `docs` beside COLUMNS; `cleaned` only on request. One pass, no shuffle."""
    names = [f.name for f in COLUMNS.fields if with_text or f.name != "cleaned"]
    # Positional names: columns of `docs` may be called like ours.
    plain = docs.select(
        F.col("text").alias("t"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    )
    shape = T.StructType([plain.schema["row"], T.StructField("q", T.StructType([COLUMNS[n] for n in names]))])
    places = [COLUMNS.names.index(n) for n in names]
    types = [{"long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_()}.get(COLUMNS[n].dataType.simpleString(), pa.string()) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "t")):
            found = [judge(t) for t in batch.column("t").to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in zip(places, types)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.StructArray.from_arrays(columns, names=names)], names=["row", "q"]
            )

    return plain.mapInArrow(run, shape)


def clean_documents(docs: DataFrame) -> DataFrame:
    """Kept documents with failing lines removed; same columns, n_chars follows the text."""
    judged = with_quality(docs, docs.columns, with_text=True).filter("q.kept")
    out = []
    for c in docs.columns:
        column = F.col("row").getField(c)
        if c == "text":
            column = F.col("q.cleaned")
        elif c == "n_chars":
            column = F.length("q.cleaned").cast("long")
        out.append(column.alias(c))
    return judged.select(*out)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
windows AS (
  SELECT doc_id, i, list_slice(words, i, i + 2) AS g
  FROM w, LATERAL (SELECT unnest(range(1, len(words) - 1)) AS i)),
twice AS (SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) AS t(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY ord) > 1 AS again,
    regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
          unnest(range(len(string_split(text, chr(10))))) AS ord FROM d)),
judged AS (
  SELECT doc_id, again, list_sum([length(x) FOR x IN words]) AS chars,
    again
    OR 3 * len([x FOR x IN words IF regexp_matches(x, '[!*$%&#|<>=~^]{2}|^[|<>»•·]$')]) > len(words)
    OR regexp_full_match(lower(line), '[\x20\x09-\x0D]*([-._=*~+#•·][\x20\x09-\x0D]*){3,}')
    OR regexp_full_match(lower(line), '""" + f"{NAV_GAP}*{NAV_ITEM}({NAV_GAP}+{NAV_ITEM})*{NAV_GAP}*" + r"""')
    OR (len(words) <= 15 AND regexp_matches(lower(line), '\b(all rights reserved|licensed under|released under)\b'))
    AS failing
  FROM lines WHERE len(words) > 0),
lost AS (
  SELECT doc_id, sum(again::INT) AS dup, coalesce(sum(chars) FILTER (failing), 0) AS lost
  FROM judged GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(words) AS n_words,
    coalesce(list_sum([length(x) FOR x IN words]), 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 30 * word_chars AS kept
FROM base
"""


@register("op2_quality_rules", ORACLE)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    judged = with_quality(table(spark, folder, "documents"), ["doc_id"])
    return judged.select(
        "row.doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words",
        "q.base_failed", "q.kept",
    )
