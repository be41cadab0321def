"""What a task of the mail parser holds and how often it parses a header, without Spark."""

from email.headerregistry import HeaderRegistry

import pyarrow as pa

from riskspark.sources import maildir


class Files:
    """Stands for the table of files: hands out the function that runs inside a task."""

    def select(self, *names):
        return self

    def mapInArrow(self, function, schema):
        return function


def parsed(contents):
    batch = pa.RecordBatch.from_pydict({"path": [f"{i}.eml" for i in range(len(contents))], "content": contents})
    return list(maildir.parse_mail(Files())(iter([batch])))


def mail(i, text):
    head = f"From: a{i}@example.com\nSubject: no {i}\nContent-Type: text/plain; charset=utf-8\n\n"
    return (head + text).encode()


def test_rows_leave_by_the_size_of_their_text():
    line = "word " * 20 + "\n"
    long = line * ((2 << 20) // len(line))  # about 2 MB, held as `text` and as `decoded`
    out = parsed([mail(i, long) for i in range(6)] + [None, mail(7, "short")])
    assert [b.num_rows for b in out] == [2, 2, 2, 2]
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["path"] for r in rows] == [f"{i}.eml" for i in range(8)]
    assert all(r["parts"][0]["text"] == long and r["error"] is None for r in rows[:6])
    assert rows[6]["error"].startswith("Failed to parse email: ") and rows[6]["subject"] == ""
    assert rows[7]["parts"][0]["decoded"] == "short" and rows[7]["sender"] == "a7@example.com"


def test_a_repeated_header_is_parsed_once(monkeypatch):
    """The type of a part is asked for many times, by the parser and by the rows."""
    calls = []
    real = HeaderRegistry.__call__
    monkeypatch.setattr(HeaderRegistry, "__call__", lambda self, name, value: calls.append(name) or real(self, name, value))
    maildir.mail_policy.cache_clear()
    rows = [r for b in parsed([mail(i, "text") for i in range(50)]) for r in b.to_pylist()]
    assert [r["subject"] for r in rows] == [f"no {i}" for i in range(50)]
    assert calls.count("Content-Type") == 1 and calls.count("From") == calls.count("Subject") == 50


def test_kept_headers_give_what_the_default_policy_gives():
    import email
    import email.policy

    long = ", ".join(f"user{i}@example.com" for i in range(40))
    raw = f"From: \"A, B\" <a@b.c>\nTo: {long}\nSubject: =?utf-8?q?caf=C3=A9?=\nSubject: two\nContent-Type: text/html; charset=nope\n\n<p>".encode()
    ours = [email.message_from_bytes(raw, policy=maildir.mail_policy()) for _ in range(2)]
    plain = email.message_from_bytes(raw, policy=email.policy.default)
    for message in ours:
        assert [(k, str(v)) for k, v in message.items()] == [(k, str(v)) for k, v in plain.items()]
        assert message.get_content_charset() == "nope" and message["from"].addresses == plain["from"].addresses
