"""Personal data: base patterns, and identifiers found from their contexts by bootstrapping.

One pass finds the base spans and, beside them, every identifier-shaped word that no base span
covers: six characters or more, four of them digits, or digits mixed with letters; digit groups with
single spaces between them are one word. Each occurrence carries the lexical patterns around it: its
two words before, and the word before with the word after.

Base spans are the seeds of a graph between patterns and instances. In each round a pattern is
supported if `SUPPORT` distinct seeds or accepted instances stand in it. An instance most of whose
patterns have no support is judged to be no identifier; other instances that are not accepted are
unknown. A pattern's trust is its good instances over its judged ones plus one; an instance's score is
one minus the product of (1 - trust) over its patterns that reach `TRUSTED`. Instances that reach
`ACCEPTED` support patterns in the next round, and rounds go on until none is new: support, trust and
scores only grow. Accepted instances, where they stand in a trusted pattern, become spans of the kind
`id`. Scores are whole millionths, so sums do not depend on their order.

Defined cases: a null text counts as empty; equal rows get equal results; ids may be null or repeat;
an empty table gives an empty result; only `doc_id` and `text` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.common import register, row_key, table, write_shared

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPED = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._/-]*[A-Za-z0-9])?")
GROUPS = re.compile(r"(?<![^\x20\x09-\x0D])[0-9]{2,}(?:\x20[0-9]{2,})+(?![^\x20\x09-\x0D])")
PAIRS = "0246813579"  # a doubled digit's digit sum
SUPPORT, TRUSTED, ACCEPTED = 3, 0.8, 0.9
MILLION = 1_000_000


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(int(PAIRS[int(c)]) for c in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each `@`: the local part cannot hold one."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    spans = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        number = digits(m[0]) if m.end() - m.start() >= 13 else ""
        if 13 <= len(number) <= 19 and luhn(number):
            spans.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits(m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def context(text: str, start: int, end: int) -> list[str]:
    """Two lexical patterns around text[start:end], from words without digits."""
    before = [w.lower() for w in WORD.findall(text[max(0, start - 80) : start])][-2:]
    after = [w.lower() for w in WORD.findall(text[end : end + 40])][:1]
    found = []
    if len(before) == 2:
        found.append(f"{before[0]} {before[1]} _")
    if before and after:
        found.append(f"{before[-1]} _ {after[0]}")
    return [p for p in found if not any(c.isdigit() for c in p)]


def occurrences(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[bool, str, int, int, list[str]]]:
    """(is a seed, value, start, end, patterns) of base spans and of identifier-shaped words."""
    found = [(True, text[s:e], s, e, context(text, s, e)) for _, s, e in spans]
    if not any("0" <= c <= "9" for c in text):
        return found
    covered = bytearray(len(text))

    def free(start: int, end: int) -> bool:
        return covered.find(1, start, end) < 0

    for _, start, end in spans:
        covered[start:end] = b"\x01" * (end - start)
    for m in GROUPS.finditer(text):
        if len(m[0]) >= 6 and len(digits(m[0])) >= 4 and free(*m.span()):
            found.append((False, m[0], *m.span(), context(text, *m.span())))
            covered[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    for word in re.finditer(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", text):
        for m in SHAPED.finditer(text, *word.span()):
            n = len(digits(m[0]))
            if len(m[0]) >= 6 and (n >= 4 or 0 < n < len(m[0])) and free(*m.span()):
                found.append((False, m[0], *m.span(), context(text, *m.span())))
    return found


def scan(docs: DataFrame) -> DataFrame:
    """Per row: counts and digests of the base spans, and the occurrences for the graph."""
    shape = T.StructType.fromDDL(
        "key binary, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string,"
        " seen array<struct<seed: boolean, value: string, start: int, stop: int, patterns: array<string>>>"
    )
    part = pa.struct(
        [("seed", pa.bool_()), ("value", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("patterns", pa.list_(pa.string()))]
    )
    kinds = [pa.binary(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(part)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = base_spans(text or "")
                counts = [sum(1 for k, _, _ in spans if k == kind) for kind in KINDS]
                seen = [dict(zip(part.names, x)) for x in occurrences(text or "", spans)]
                base = listed(spans)
                digest = hashlib.sha256(base.encode()).hexdigest()
                rows.append((row_key(doc_id, text), doc_id, *counts, digest, base, seen))
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=shape.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, shape)


def bootstrap(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns and accepted instances of (pattern, value, seed).

    Every round joins the edges with the few supported patterns and is written. What it accepted
    stays accepted, so the rounds end.
    """
    edges = write_shared(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    places = write_shared(edges.filter("not seed").groupBy("value").agg(F.count("*").alias("places")), "pii-places")
    accepted, known = edges.select("value").limit(0), -1
    while True:
        # An accepted value counts once for each of its patterns, as a seed does.
        good = edges.filter("seed").select("pattern").unionAll(
            edges.filter("not seed").join(accepted, "value", "left_semi").select("pattern")
        )
        supported = good.groupBy("pattern").agg(F.count("*").alias("good")).filter(f"good >= {SUPPORT}")
        supported = write_shared(supported, "pii-supported")
        touched = write_shared(edges.filter("not seed").join(supported, "pattern").select("pattern", "value"), "pii-touched")
        held = touched.groupBy("value").agg(F.count("*").alias("held")).join(places, "value")
        failed = held.filter("2 * held < places").select("value").join(accepted, "value", "left_anti")
        bad = touched.join(failed, "value", "left_semi").groupBy("pattern").agg(F.count("*").alias("bad"))
        judged = supported.join(bad, "pattern", "left").withColumn("bad", F.coalesce("bad", F.lit(0)))
        trust = F.floor(F.col("good") * MILLION / (F.col("good") + F.col("bad") + 1)).cast("long")
        judged = judged.select("pattern", trust.alias("trust")).filter(f"trust >= {int(TRUSTED * MILLION)}")
        patterns = write_shared(judged, "pii-patterns")
        doubt = F.round(F.log1p(-F.col("trust") / MILLION) * MILLION).cast("long")
        values = touched.join(patterns, "pattern").groupBy("value").agg(F.sum(doubt).alias("doubt"))
        gained = F.floor((1 - F.exp(F.col("doubt") / MILLION)) * MILLION)
        accepted = write_shared(values.filter(gained >= int(ACCEPTED * MILLION)).select("value"), "pii-accepted")
        before, known = known, accepted.count()
        if known == max(before, 0):
            return patterns, accepted


def find(docs: DataFrame) -> DataFrame:
    """Base columns, `spans` (base spans and discovered ones) and `n_found` (discovered ones) for every row."""
    rows = write_shared(scan(docs), "pii")
    seen = rows.select("key", F.explode("seen").alias("x")).select("key", "x.*")
    seen = seen.select("key", "seed", "value", "start", "stop", F.explode("patterns").alias("pattern"))
    patterns, sure = bootstrap(seen.select("pattern", "value", "seed"))
    # Trusted patterns and accepted values are few; adaptive execution sees their sizes.
    added = seen.filter("not seed").join(patterns.select("pattern"), "pattern", "left_semi").join(sure, "value", "left_semi")
    added = added.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("found"))
    texts = F.transform("found", lambda s: F.format_string("id:%d:%d", s["start"], s["stop"]))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join(texts, ","))
    joined = rows.drop("seen").join(added, "key", "left")
    n_found = F.coalesce(F.array_size("found"), F.lit(0)).cast("long")
    return joined.withColumns({"spans": spans, "n_found": n_found}).drop("key", "base", "found")


@register("op5_pii")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = find(table(spark, folder, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_found")
