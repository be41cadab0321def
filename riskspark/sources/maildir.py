"""Mail files to typed rows: the standard MIME parser runs inside Spark tasks."""

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.staging import hold
from riskspark.functions.text import collapse_ws, strip_ws
from riskspark.operators import mail

PARSED = (
    "path string, sender string, recipient string, subject string, date string, "
    "reply_to string, return_path string, received array<string>, auth_results string, "
    "multipart boolean, parts array<struct<ord: int, content_type: string, "
    "disposition: string, attached: boolean, filename: string, text: string, decoded: string>>, "
    "error string"
)
OUT_CHARS = 4 << 20  # parsed text that a task holds before it hands the rows on
KEPT_HEADERS = 256  # parsed header values that a task keeps
KEPT_CHARS = 200  # longer header values are parsed at every use


@lru_cache(maxsize=1)
def mail_policy():
    """The default policy with the last header values kept parsed: a part's type alone is asked for some ten times."""
    import email.policy
    from email.headerregistry import HeaderRegistry

    parse = HeaderRegistry()
    kept = lru_cache(maxsize=KEPT_HEADERS)(parse)
    return email.policy.EmailPolicy(
        header_factory=lambda name, value: (kept if len(value) <= KEPT_CHARS else parse)(name, value)
    )


@lru_cache(maxsize=1)
def parsed_schema():
    """PARSED as an Arrow schema."""
    import pyarrow as pa

    texts = lambda names: [(n, pa.string()) for n in names.split()]
    part = [
        ("ord", pa.int32()), *texts("content_type disposition"), ("attached", pa.bool_()), *texts("filename text decoded")
    ]
    return pa.schema(
        [
            *texts("path sender recipient subject date reply_to return_path"), ("received", pa.list_(pa.string())),
            *texts("auth_results"), ("multipart", pa.bool_()), ("parts", pa.list_(pa.struct(part))), *texts("error"),
        ]
    )


def read_mail_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every .eml file below a directory."""
    return (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup=True, pathGlobFilter="*.[eE][mM][lL]")
        .load(path)
        .select("path", "content")
    )


def parse_mail(files: DataFrame) -> DataFrame:
    """Headers and parts of each message; files that cannot be parsed get `error`.

    Messages are read one by one and rows leave a task by the size of their text, so that its memory
    depends on neither the number nor the length of the messages in a batch.
    """

    def parse(batches):
        import email

        import pyarrow as pa

        policy, schema = mail_policy(), parsed_schema()

        def decoded(part):
            payload = part.get_payload(decode=True)
            if not isinstance(payload, bytes):
                return ""
            try:
                return payload.decode(part.get_content_charset() or "utf-8", errors="replace")
            except LookupError:
                return payload.decode("utf-8", errors="replace")

        def content(part):
            try:
                value = part.get_content()
                return value if isinstance(value, str) else decoded(part)
            except Exception:
                return decoded(part)

        def header(message, name):
            value = message.get(name)
            return "" if value is None else str(value)

        def row(path, raw):
            message = email.message_from_bytes(raw, policy=policy)
            multipart = message.is_multipart()
            parts = []
            for part in message.walk() if multipart else [message]:
                disposition = header(part, "Content-Disposition")
                if part.is_multipart() and "attachment" not in disposition:
                    continue
                kind = part.get_content_type()
                readable = kind.startswith("text/") or not multipart
                parts.append(
                    {
                        "ord": len(parts),
                        "content_type": kind,
                        "disposition": disposition,
                        "attached": part.get_content_disposition() == "attachment",
                        "filename": part.get_filename() or "",
                        "text": content(part) if readable else "",
                        "decoded": decoded(part) if readable else "",
                    }
                )
            return {
                "path": path,
                "sender": header(message, "From"),
                "recipient": header(message, "To"),
                "subject": header(message, "Subject"),
                "date": header(message, "Date"),
                "reply_to": header(message, "Reply-To"),
                "return_path": header(message, "Return-Path"),
                "received": [str(v) for v in message.get_all("Received", [])],
                "auth_results": header(message, "Authentication-Results"),
                "multipart": multipart,
                "parts": parts,
                "error": None,
            }

        def failed(path, problem):
            empty = row(path, b"")
            return {**empty, "error": f"Failed to parse email: {problem}"}

        for batch in batches:
            rows, held = [], 0
            for path, raw in zip(batch.column("path"), batch.column("content")):
                path, raw = path.as_py(), raw.as_py()
                try:
                    rows.append(row(path, bytes(raw)))
                except Exception as problem:
                    rows.append(failed(path, problem))
                held += sum(len(p["text"]) + len(p["decoded"]) for p in rows[-1]["parts"])
                if held > OUT_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(parse, PARSED)


def read_mail_dir(spark: SparkSession, path: str) -> DataFrame:
    """Parsed messages with bodies, attachments, links and header status, one row per file."""
    parsed = parse_mail(read_mail_files(spark, path))
    return mail_rows(parsed)


def mail_rows(parsed: DataFrame) -> DataFrame:
    folded = mail.auth_status(mail.fold_nested_parts(parsed))
    return mail.extract_links(folded, "upload")


def corpus_text(parsed: DataFrame) -> DataFrame:
    """Training text of parsed messages: headers, blank line, plain parts (no shuffle)."""
    plain = F.filter("parts", lambda p: ~p["attached"] & (F.lower(p["content_type"]) == "text/plain"))
    body = strip_ws(F.array_join(F.transform(plain, lambda p: p["decoded"]), "\n"))
    return parsed.withColumn("text", mail.corpus_body(body))


def read_mail_corpus(spark: SparkSession, safe_dir: str, phishing_dir: str) -> DataFrame:
    """(path, src_ord, text, label) of two directories; safe mail comes first."""
    tables = []
    for place, (folder, label) in enumerate(((safe_dir, 0), (phishing_dir, 1))):
        rows = corpus_text(parse_mail(read_mail_files(spark, folder)))
        cleaned = rows.select(
            "path",
            F.lit(place).alias("src_ord"),
            collapse_ws(F.col("text")).alias("text"),
            F.lit(label).alias("label"),
        )
        tables.append(hold(cleaned, "text"))
    return tables[0].unionByName(tables[1]).filter(F.col("text") != "")
