"""Secret scans by multipart credential linking, in DataFrame functions throughout.

Every text gives parts, each an interval of code points: access identifiers, secrets and endpoints. Some
are certain by their form alone (the base rules); the others are weak candidates: short or mixed values,
user names, addresses. A scope is a paragraph (text between blank lines). Parts are joined within their
scope as intervals: both sides stand in the bins of `REACH` characters that they touch, the weak side
also in those it can reach, and a weak candidate is reported only if a complementary part is within
`REACH`: a value needs an identifier or endpoint, an identifier or endpoint needs a secret. The join is a
semi-join, so its output never exceeds the candidates, however many parts a scope holds.

A text is located once per distinct text. Positions come from the lengths between matches, summed in a
window per text and pattern, so a very long text costs time in proportion to its length. Texts without
any match, most of them, stay out of all joins, as do weak parts of texts without any secret. One text's
spans are collected in one row, bounded by that text.

Defined cases: null and empty texts have no spans; equal texts have equal spans; base spans of different
kinds may overlap, and weak candidates that overlap a base span are left out, weak ones may overlap each
other; an empty table gives an empty result; other columns, whatever their names, are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.llm.common import register, table, write_shared

KINDS = ["assign", "access", "hex", "value", "id", "endpoint"]  # in the order of equal starts
REACH = 200  # characters between complementary parts
LEAST = {"assign": 12, "access": 18, "weak value": 6}
BLANK = r"\n[\x20\x09\x0D]*\n"  # ends a scope


def either_case(words: str) -> str:
    """A pattern for words in either case of their letters; `_?` stays."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


def assigned(words: str, value: str) -> str:
    return rf"""({either_case(words)})["']?\x20*[:=]\x20*["']?({value})"""


# Fixed base patterns; each maximal run of hex digits and of what follows AKIA is one match.
ASSIGN = assigned("password|passwd|secret|token|api_?key", r"[A-Za-z0-9+/_.=-]+")
ACCESS = "AKIA[A-Z0-9]{4,}"
HEX = "[0-9a-f]{16,}"
# Own patterns of weak candidates.
NAMED_VALUE = assigned("pwd|pass|passphrase|passcode|private_?key|secret_?key|access_?key|auth|credential", r"[A-Za-z0-9+/_.=!@#$%^&*-]+")
USER_INFO = r"""://[A-Za-z0-9._%+-]+:[^\x20\x09-\x0D@/:"']+@"""
MIXED = "[A-Za-z0-9+/_=-]{20,}"
NAMED_ID = assigned("user|user_?name|login|account|client_?id|key_?id|access_?key_?id|tenant", r"[A-Za-z0-9@._+-]{3,}")
ADDRESS = r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+"""
NAMED_PLACE = assigned("host|host_?name|server|endpoint|bucket|region|database", r"[A-Za-z0-9._:/-]{3,}")


def value_of(match: Column, pattern: str) -> Column:
    return F.regexp_extract(match, pattern, 2)


def _digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def _patterns() -> list[tuple]:
    """(pattern, what its texts must hold, kind or null of a match)."""
    weak_value = lambda v: (F.length(v) >= LEAST["weak value"]) & _digit(v)
    mixed = lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & _digit(m)

    def base_assign(m: Column) -> Column:
        v = value_of(m, ASSIGN)
        return F.when(F.length(v) >= LEAST["assign"], "assign").when(weak_value(v), "value")

    return [
        (ASSIGN, "[:=]", base_assign),
        (ACCESS, "AKIA", lambda m: F.when(F.length(m) >= LEAST["access"], "access").otherwise("id")),
        (HEX, None, lambda m: F.lit("hex")),
        (NAMED_VALUE, "[:=]", lambda m: F.when(weak_value(value_of(m, NAMED_VALUE)), "value")),
        (USER_INFO, "://", lambda m: F.lit("value")),
        (MIXED, None, lambda m: F.when(mixed(m), "value")),
        (NAMED_ID, "[:=]", lambda m: F.lit("id")),
        (ADDRESS, "://", lambda m: F.lit("endpoint")),
        (NAMED_PLACE, "[:=]", lambda m: F.lit("endpoint")),
    ]


PATTERNS = _patterns()
BREAKS = len(PATTERNS)  # number of the scope ends among the patterns
SECRETS = ["assign", "hex", "value"]
ROLE = {"assign": "secret", "hex": "secret", "value": "secret", "access": "id", "id": "id", "endpoint": "endpoint"}
NEEDS = {"value": ["id", "endpoint"], "id": ["secret"], "endpoint": ["secret"]}


def marks(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(row: the named columns, key, marks): the matches in each text as lengths; both null without any.

    A mark holds the pattern's number, the place among its matches, the characters since the match
    before (gap), its own length and its kind, null for one that only counts for the positions.
    """
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("t"))
    for k, (pattern, holds, _) in enumerate(PATTERNS):
        all_of = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        found = found.withColumn(f"m{k}", all_of if holds is None else F.when(F.col("t").rlike(holds), all_of))
    parts = []
    for k, (pattern, _, kind_of) in enumerate(PATTERNS):
        parts.append(_located(F.col(f"m{k}"), pattern, k, kind_of))
    # The gap after the last match is dropped with the shorter of both lists.
    found = found.select("row", "t", F.flatten(F.array(*parts)).alias("marks"))
    secret = F.exists("marks", lambda m: m["kind"].isin(SECRETS))
    base = F.filter("marks", lambda m: m["pattern"] == 1)  # all that a text without a secret can report
    held = F.when(secret, F.col("marks")).otherwise(base)
    weak = F.exists("marks", lambda m: m["kind"].isin(list(NEEDS)))
    ends = _located(F.when(secret & weak, F.regexp_extract_all("t", F.lit(BLANK), F.lit(0))), BLANK, BREAKS, lambda m: F.lit(None).cast("string"))
    every = F.concat(held, ends)
    some = F.size(held) > 0
    return found.select("row", F.when(some, F.sha2("t", 256)).alias("key"), F.when(some, every).alias("marks"))


def _located(matches: Column, pattern: str, number: int, kind_of) -> Column:
    between = F.split("t", pattern, -1)
    kind = "struct<pattern:int,place:int,gap:int,len:int,kind:string>"
    pairs = F.transform(
        F.arrays_zip(F.slice(between, F.lit(1), F.size(matches)).alias("b"), matches.alias("m")),
        lambda p, i: F.struct(
            F.lit(number).alias("pattern"), i.alias("place"), F.length(p["b"]).alias("gap"), F.length(p["m"]).alias("len"),
            kind_of(p["m"]).alias("kind"),
        ),
    )
    return F.when(F.size(matches) > 0, pairs).otherwise(F.array().cast(f"array<{kind}>"))


def parts(marked: DataFrame) -> DataFrame:
    """(key, kind, start, end, base, scope) of every part, for each distinct text once; code points."""
    # A text that fills a third of the table leaves each task as one row.
    once = marked.filter("key IS NOT NULL").groupBy("key").agg(F.first("marks").alias("marks"))
    each = once.select("key", F.explode("marks").alias("m")).select("key", "m.*")
    run = Window.partitionBy("key", "pattern").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(run))
    placed = placed.withColumn("start", F.col("end") - F.col("len")).filter(F.col("kind").isNotNull() | (F.col("pattern") == BREAKS))
    base = F.col("kind").isin("assign", "access", "hex")
    upto = Window.partitionBy("key").orderBy("start")
    later = Window.partitionBy("key").orderBy(F.desc("start"))  # a running minimum from the end
    return (
        placed.withColumn("base", F.coalesce(base, F.lit(False)))
        .withColumn("scope", F.sum((F.col("pattern") == BREAKS).cast("long")).over(upto))
        .withColumn("covered", F.max(F.when(F.col("base"), F.col("end"))).over(upto) > F.col("start"))
        .withColumn("covers", F.min(F.when(F.col("base"), F.col("start"))).over(later) < F.col("end"))
        .filter(F.col("kind").isNotNull() & (F.col("base") | ~(F.coalesce("covered", F.lit(False)) | F.coalesce("covers", F.lit(False)))))
        .select("key", "kind", "start", "end", "base", "scope")
        .distinct()
    )


def _bins(low: Column, high: Column, reach: int) -> Column:
    """The bins of `reach` characters that [low, high) touches."""
    return F.explode(F.sequence(F.floor(low / reach), F.floor((high - 1) / reach)))


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts of `found` that have a complementary part within reach in their scope."""
    needs = F.when(F.lit(False), F.array(F.lit("")))
    for kind, roles in NEEDS.items():
        needs = needs.when(F.col("kind") == kind, F.array(*map(F.lit, roles)))
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])[F.col("kind")]
    start, end = F.col("start"), F.col("end")
    weak = found.filter(~F.col("base")).withColumn("role", F.explode(needs))
    weak = weak.withColumn("bin", _bins(F.greatest(start - reach, F.lit(0)), end + reach, reach)).alias("w")
    others = found.select("key", "scope", start.alias("s"), end.alias("e"), role.alias("role"), _bins(start, end, reach).alias("bin")).alias("o")
    same = [F.col(f"w.{c}") == F.col(f"o.{c}") for c in ("key", "scope", "role", "bin")]
    near = (F.col("w.start") - F.col("o.e") <= reach) & (F.col("o.s") - F.col("w.end") <= reach)
    joined = weak.join(others, [*same, near], "left_semi")
    return joined.select(*found.columns).distinct()


def scan_secrets(docs: DataFrame, keep: list[str], text: str = "text", reach: int = REACH) -> DataFrame:
    """(row: the named columns, spans) of every document; spans in order, with kind, start, end, base."""
    marked = write_shared(marks(docs, keep, text), "marks")
    found = write_shared(parts(marked), "parts")
    reported = found.filter("base").unionByName(linked(found, reach))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    listed = reported.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", number.alias("n"), "end", "kind", "base"))).alias("all"))
    spans = F.transform("all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    told = marked.filter("key IS NOT NULL").select("row", "key").join(listed.select("key", spans.alias("spans")), "key", "left")
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    with_none = marked.filter("key IS NULL").select("row", empty.alias("spans"))
    return told.select("row", F.coalesce("spans", empty).alias("spans")).union(with_none)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _oracle() -> str:
    """The same rules over DuckDB's lists, with plain distances instead of bins."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    value = lambda p: f"regexp_extract(m, {quote(p)}, 2)"
    weak = lambda p: f"length({value(p)}) >= {LEAST['weak value']} AND regexp_matches({value(p)}, '[0-9]')"
    kinds = [
        (ASSIGN, f"CASE WHEN length({value(ASSIGN)}) >= {LEAST['assign']} THEN 'assign' WHEN {weak(ASSIGN)} THEN 'value' END"),
        (ACCESS, f"CASE WHEN length(m) >= {LEAST['access']} THEN 'access' ELSE 'id' END"),
        (HEX, "'hex'"),
        (NAMED_VALUE, f"CASE WHEN {weak(NAMED_VALUE)} THEN 'value' END"),
        (USER_INFO, "'value'"),
        (MIXED, "CASE WHEN regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') THEN 'value' END"),
        (NAMED_ID, "'id'"), (ADDRESS, "'endpoint'"), (NAMED_PLACE, "'endpoint'"), (BLANK, "'break'"),
    ]
    found = " UNION ALL ".join(
        f"""SELECT u, {kind} AS kind, "end" - length(m) AS start, "end" FROM (SELECT u, m, sum(length(b) + length(m)) OVER (PARTITION BY u ORDER BY i) AS "end"
        FROM (SELECT u, unnest(regexp_extract_all(text, {quote(p)})) AS m, unnest(list_slice(string_split_regex(text, {quote(p)}), 1, len(regexp_extract_all(text, {quote(p)})))) AS b,
        unnest(range(len(regexp_extract_all(text, {quote(p)})))) AS i FROM d))"""
        for p, kind in kinds
    )
    roles = " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in ROLE.items())
    fits = " OR ".join(f"w.kind = '{k}' AND o.role IN ({', '.join(map(quote, r))})" for k, r in NEEDS.items())
    order = f"list_position([{', '.join(map(quote, KINDS))}], kind)"
    told = "kind || ':' || start || ':' || \"end\""
    return f"""WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS text FROM documents),
    f AS (SELECT DISTINCT u, kind, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM ({found}) WHERE kind IS NOT NULL),
    p AS (SELECT *, CASE kind {roles} END AS role, kind IN ('assign', 'access', 'hex') AS base,
      (SELECT count(*) FROM f x WHERE x.u = f.u AND x.kind = 'break' AND x.start <= f.start) AS scope FROM f WHERE kind <> 'break'),
    q AS (SELECT * FROM p WHERE base OR NOT EXISTS (SELECT 1 FROM p x WHERE x.u = p.u AND x.base AND x.start < p."end" AND x."end" > p.start)),
    r AS (SELECT * FROM q WHERE base UNION SELECT w.* FROM q w JOIN q o ON w.u = o.u AND w.scope = o.scope AND w.start - o."end" <= {REACH} AND o.start - w."end" <= {REACH}
      WHERE NOT w.base AND ({fits})),
    a AS (SELECT u, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg({told}, ',' ORDER BY start, {order}, "end") FILTER (base) AS bases, string_agg({told}, ',' ORDER BY start, {order}, "end") AS spans FROM r GROUP BY u)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(bases, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (u)"""


@register("op11_secret_scans", _oracle())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scan_secrets(docs, ["doc_id"])
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.filter("spans", lambda s: s["base"])
    return found.select("row.doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
