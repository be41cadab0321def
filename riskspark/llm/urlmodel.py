"""URL filter: rules first, then the ratio of two character models.

URLs that a rule decides teach two variable-order Markov models, one of accepted and one of rejected
addresses. A character's probability blends the orders from none up to four preceding characters
by Witten-Bell smoothing: the more distinct followers a context has, the more the shorter
context counts, and a context never seen leaves it to the shorter one. An address is judged by the
difference of its two log-likelihoods per character. The cut is calibrated on every fifth
rule-decided address, which is kept out of training: it blocks at most `MISSED` of the accepted.

All steps are joins and sums over distinct character windows; a window's score is a whole number of
millionths, so sums do not depend on their order.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule and is judged
on the empty text; without accepted or rejected examples the difference is 0 and the cut is 0, so the
rest is allowed; equal urls are scored once; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import register, table, write_shared

ORDER = 4  # preceding characters of the longest context
MISSED = 0.02
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SIDES = ("accepted", "rejected")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty where there is no `://`."""
    host = F.translate(F.regexp_extract(url, ADDRESS, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def apply_rules(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Adds host, path, rule and the rule's verdict; the longest fitting rule wins."""
    host, path = split_url(F.col("url"))
    ruled, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        top, slash, below = rule.partition("/")
        fits = (F.col("host") == top) | F.col("host").endswith("." + top)
        fits = fits & F.col("path").startswith(slash + below)
        ruled, decided = F.when(fits, rule).otherwise(ruled), F.when(fits, verdict).otherwise(decided)
    return pages.withColumns({"host": host, "path": path}).withColumns({"rule": ruled, "decided": decided})


def windows(urls: DataFrame, text: Column) -> DataFrame:
    """One row per character: the character after its ORDER predecessors, `window`."""
    padded = F.concat(F.lit("\u0002" * ORDER), text, F.lit("\u0003"))
    places = F.sequence(F.lit(1), F.length(text) + 1)
    cut = F.transform(places, lambda i: F.substring(F.col("padded"), i, F.lit(ORDER + 1)))
    return urls.withColumn("padded", padded).withColumn("window", F.explode(cut)).drop("padded")


def fit(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts from rows (window, verdict).

    grams: gram, and per side how often it occurred; contexts: context, and per side how often it
    was continued and with how many distinct characters.
    """
    per_side = {s: F.sum((F.col("verdict") == v).cast("long")) for s, v in zip(SIDES, ("allow", "block"))}
    seen = examples.groupBy("window").agg(*[n.alias(s) for s, n in per_side.items()])
    ends = F.explode(F.array(*[F.substring("window", ORDER + 2 - j, j) for j in range(1, ORDER + 2)]))
    grams = seen.withColumn("gram", ends).groupBy("gram").agg(*[F.sum(s).alias(s) for s in SIDES])
    grams = write_shared(grams, "grams")
    contexts = grams.withColumn("context", F.expr("left(gram, length(gram) - 1)")).groupBy("context").agg(
        *[F.sum(s).alias(f"{s}_all") for s in SIDES],
        *[F.sum((F.col(s) > 0).cast("long")).alias(f"{s}_kinds") for s in SIDES],
    )
    return grams, contexts


def score_windows(distinct: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """window and `gain`, log(accepted / rejected) of its last character in millionths."""
    # The empty context would be one key for a fifth of all rows: each character has a copy of its line.
    facts = [f"{s}{part}" for s in SIDES for part in ("_all", "_kinds")]
    none = contexts.filter("context = ''").first()
    single = distinct.select(F.concat(F.lit("\u0000"), F.expr("right(window, 1)")).alias("context")).distinct()
    single = single.withColumns({f: F.lit(none[f] if none else 0).cast("long") for f in facts})
    contexts = contexts.filter("context <> ''").unionByName(single)
    orders = F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1)))
    rows = distinct.withColumn("j", orders).withColumn("gram", F.expr(f"substring(window, {ORDER + 2} - j, j)"))
    shorter = F.when(F.col("j") == 1, F.concat(F.lit("\u0000"), "gram")).otherwise(F.expr("left(gram, j - 1)"))
    rows = rows.withColumn("context", shorter)
    rows = rows.join(grams, "gram", "left").join(contexts, "context", "left")
    facts = [f"{s}{part}" for s in SIDES for part in ("", "_all", "_kinds")]
    gathered = rows.groupBy("window").agg(
        F.sort_array(F.collect_list(F.struct("j", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in facts]))).alias("steps")
    )

    def probability(side: str) -> Column:
        def blend(shorter: Column, step: Column) -> Column:
            total, kinds = step[f"{side}_all"], step[f"{side}_kinds"]
            longer = (step[side] + kinds * shorter) / F.greatest(total + kinds, F.lit(1))
            return F.when(total > 0, longer).otherwise(shorter)

        return F.aggregate("steps", F.lit(1.0 / 65536), blend)

    gain = F.ln(probability(SIDES[0])) - F.ln(probability(SIDES[1]))
    return gathered.select("window", F.round(gain * 1e6).cast("long").alias("gain"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and `score` in millionths per character (null if ruled)."""
    ruled = write_shared(apply_rules(pages.select("page_id", "url"), rules), "ruled")
    text = F.concat("host", "path")
    # Equal addresses are one: a third of the table may be one url.
    urls = ruled.groupBy("host", "path").agg(F.first("decided").alias("verdict"))
    urls = urls.withColumn("text", text).withColumn("id", F.xxhash64("host", "path"))
    urls = urls.withColumn("kept_out", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(5)) == 0)
    urls = write_shared(urls, "urls")
    grams, contexts = fit(windows(urls.filter("verdict is not null and not kept_out").select("verdict", "text"), F.col("text")))
    asked = urls.filter("verdict is null or kept_out")
    cut = windows(asked.select("id", "text"), F.col("text")).select("id", "window")
    gains = write_shared(score_windows(cut.select("window").distinct(), grams, contexts), "gains")
    sums = cut.join(gains, "window").groupBy("id").agg(F.sum("gain").alias("gain"), F.count("*").alias("n"))
    scored = asked.join(sums, "id").withColumn("score", F.floor(F.col("gain") / F.col("n")).cast("long"))
    scored = write_shared(scored.select("host", "path", "verdict", "score"), "scored")
    limit = scored.filter("verdict = 'allow'").agg(
        F.expr(f"percentile_disc({MISSED}) within group (order by floor(score / 1000))").alias("low")
    ).first()["low"]
    limit = 0 if limit is None else int(limit) * 1000
    rest = scored.filter("verdict is null").drop("verdict")
    judged = ruled.join(rest, ["host", "path"], "left")
    by_model = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return judged.withColumn("verdict", F.coalesce("decided", by_model))


@register("op6_url_filters")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(table(spark, folder, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")
