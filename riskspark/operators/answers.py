"""Tables around an external language model: prompts out, answers in."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.text import strip_ws

# The answer format the parser reads and the questions per channel.
ANSWER_FORMAT = (
    "Respond in this exact format:\n"
    "SCORE: [0-100 risk score]\n"
    "VERDICT: [SAFE, SUSPICIOUS, or PHISHING]\n"
    "ANALYSIS: [2-3 sentence analysis explaining your reasoning]\n"
)
URL_ASPECTS = [
    "Domain reputation and legitimacy",
    "Typosquatting or brand impersonation",
    "URL structure anomalies",
    "Known phishing patterns",
    "Social engineering tactics",
]
MAIL_ASPECTS = [
    "Social engineering tactics (urgency, fear, greed)",
    "Spoofing indicators",
    "Suspicious links or attachments",
    "Grammar/formatting anomalies typical of phishing",
    "Whether this matches known phishing campaigns",
]
SMS_ASPECTS = [
    "Smishing (SMS phishing) patterns",
    "Urgency or fear tactics",
    "Prize/lottery scam indicators",
    "Suspicious links",
    "Impersonation of legitimate services",
    "OTP/verification code theft attempts",
]


def _numbered(aspects: list[str]) -> str:
    return "".join(f"{i}. {a}\n" for i, a in enumerate(aspects, 1))


def build_prompts(df: DataFrame, channel: str) -> DataFrame:
    """(id, prompt) rows that a separate caller can send to its model."""
    if channel == "url":
        body = [
            F.lit(
                "You are a cybersecurity expert analyzing URLs for phishing threats.\n\n"
                "Analyze this URL for phishing indicators: "
            ),
            F.col("url"),
            F.lit("\n\nConsider:\n" + _numbered(URL_ASPECTS) + "\n" + ANSWER_FORMAT),
        ]
    elif channel == "email":
        links = F.array_join(F.slice("links", 1, 5), ", ")
        body = [
            F.lit(
                "You are a cybersecurity expert analyzing emails for phishing threats.\n\n"
                "Analyze this email:\n- From: "
            ),
            F.coalesce("sender", F.lit("")),
            F.lit("\n- Subject: "),
            F.coalesce("subject", F.lit("")),
            F.lit("\n- Body Preview: "),
            F.substr(F.coalesce("body_preview", F.lit("")), F.lit(1), F.lit(500)),
            F.lit("\n- Links found: "),
            F.when(F.coalesce(F.size("links"), F.lit(0)) > 0, links).otherwise("None"),
            F.lit("\n\nEvaluate for:\n" + _numbered(MAIL_ASPECTS) + "\n" + ANSWER_FORMAT),
        ]
    elif channel == "sms":
        sender = F.coalesce("sender", F.lit(""))
        body = [
            F.lit(
                "You are a cybersecurity expert analyzing SMS messages for phishing and scam "
                "threats.\n\nAnalyze this SMS:\n- Sender: "
            ),
            F.when(sender == "", "Unknown").otherwise(sender),
            F.lit("\n- Message: "),
            F.col("message"),
            F.lit("\n\nEvaluate for:\n" + _numbered(SMS_ASPECTS) + "\n" + ANSWER_FORMAT),
        ]
    else:
        raise ValueError(f"Unknown channel: {channel}")
    return df.select("id", F.concat(*body).alias("prompt"))


def parse_llm_answers(df: DataFrame, col: str = "answer", failed: str | None = None) -> DataFrame:
    """Read score, verdict and analysis out of the answer text.

    A null answer, or one whose `failed` column is true, is no success and has score 0.
    """
    answer = F.col(col)
    success = answer.isNotNull()
    if failed:
        success = success & ~F.coalesce(F.col(failed), F.lit(False))
    digits = F.regexp_extract(answer, r"(?i)SCORE:\s*(\d+)", 1)
    word = F.upper(F.regexp_extract(answer, r"(?i)VERDICT:\s*(SAFE|SUSPICIOUS|PHISHING)", 1))
    has_analysis = answer.rlike(r"(?i)ANALYSIS:")
    analysis = strip_ws(F.regexp_extract(answer, r"(?is)ANALYSIS:\s*(.*)", 1))
    # More digits than a number can hold still mean "above 100".
    number = F.least(F.coalesce(digits.try_cast("double"), F.lit(100.0)), F.lit(100.0)).cast("int")
    return df.withColumns(
        {
            "llm_available": F.lit(True),
            "llm_success": success,
            "llm_score": F.when(success & (digits != ""), number).otherwise(0),
            "llm_verdict": F.when(success & (word != ""), word).otherwise("UNKNOWN"),
            "llm_analysis": F.when(~success, "Not available").when(has_analysis, analysis).otherwise(answer),
        }
    )


def one_answer(answers: DataFrame, key: str = "id", col: str = "answer", at: str = "at") -> DataFrame:
    """One answer per record: the latest by the `at` column if there is one, then the greatest text."""
    others = [c for c in answers.columns if c not in (key, col, at)]
    order = [F.col(at)] if at in answers.columns else []
    best = F.max(F.struct(F.col(col).isNotNull().alias("given"), *order, F.col(col), *others)).alias("best")
    kept = [c for c in answers.columns if c != key]
    return answers.groupBy(key).agg(best).select(key, *[F.col("best").getField(c).alias(c) for c in kept])


def attach_llm(df: DataFrame, answers: DataFrame, key: str = "id", failed: str | None = None) -> DataFrame:
    """Left-join parsed answers; records without a usable one keep score 0.

    Several answers to one record are reduced by `one_answer`, so no record is multiplied.
    """
    parsed = parse_llm_answers(one_answer(answers, key), failed=failed).select(
        key, "llm_available", "llm_success", "llm_score", "llm_verdict", "llm_analysis"
    )
    joined = df.join(parsed, key, "left")
    return joined.withColumns(
        {
            "llm_available": F.coalesce("llm_available", F.lit(False)),
            "llm_success": F.coalesce("llm_success", F.lit(False)),
            "llm_score": F.coalesce("llm_score", F.lit(0)),
            "llm_analysis": F.coalesce("llm_analysis", F.lit("Not available")),
        }
    )
