"""Links inside messages: extraction and scoring without moving the message."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import lexicon
from riskspark.functions import urls
from riskspark.functions.staging import hold

RISKY_ABOVE = 40  # a link is risky when its rule score exceeds this


def find_links(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def extract_links(df: DataFrame, mode: str) -> DataFrame:
    """Add `links`. `upload`: distinct in order of first occurrence; `form`: all matches."""
    if mode == "upload":
        text = F.concat(_text("body_text"), F.lit(" "), _text("body_html"))
        return df.withColumn(
            "links", F.array_distinct(find_links(text, lexicon.MAIL_LINK_PATTERN))
        )
    if mode == "form":
        text = F.concat(_text("body_text"), F.lit(" "), _text("links_text"))
        return df.withColumn("links", find_links(text, lexicon.FORM_LINK_PATTERN))
    raise ValueError(f"Unknown mode: {mode}")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def score_links(df: DataFrame, links: str = "links", limit: int = 10) -> DataFrame:
    """Add links_analyzed, link_max, risky_links for the first `limit` links of each row.

    The URL rules run inside the row's own array, so a message never shuffles and a
    link shared by a third of all messages is no hot key.
    """
    scored = urls.on_array(
        F.slice(links, 1, limit), urls.SCORING, ["url", "rule_score", "error"]
    )
    usable = F.transform(
        F.filter(scored, lambda s: s["error"].isNull()),
        lambda s: F.struct(s["url"].alias("url"), s["rule_score"].alias("rule_score")),
    )
    df = hold(df.withColumn("links_analyzed", usable), "links_analyzed")
    scores = F.col("links_analyzed.rule_score")
    return df.withColumns(
        {
            "link_max": F.coalesce(F.array_max(scores), F.lit(0)),
            "risky_links": F.size(F.filter(scores, lambda s: s > RISKY_ABOVE)),
        }
    )
