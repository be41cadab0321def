"""Line dedup against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from riskspark.llm import linededup
from riskspark.llm.linededup import EDITS, MIN_CHARS, dedup_documents, dropped_lines, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(rng, line, edits):
    chars = list(line)
    for _ in range(edits):
        i = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars.insert(i, rng.choice("abé"))
        elif kind == 1:
            chars.pop(i)
        else:
            chars[i] = rng.choice("abé")
    return "".join(chars)


def test_banded_distance(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé ") for _ in range(rng.randint(20, 40)))
        pairs.append((a, edited(rng, a, rng.randint(0, 4))))
    pairs = [p for p in pairs if min(map(len, p)) >= MIN_CHARS]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", within(F.col("a"), F.col("b")).alias("w"))
    for r in got.collect():
        assert r["w"] == (distance(r["a"], r["b"]) <= EDITS), (r["a"], r["b"])


def brute(rows):
    """{(doc_id, line_no)} to drop; rows in the order of their places."""
    earlier, gone = [], set()
    for doc_id, text in rows:
        for no, line in enumerate(text.split("\n")):
            if len(line) >= MIN_CHARS:
                if any(abs(len(line) - len(e)) <= EDITS and distance(line, e) <= EDITS for e in earlier):
                    gone.add((doc_id, no))
                earlier.append(line)
    return gone


@pytest.mark.parametrize("hot", [32, 1])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT", hot)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(18, 60))) for _ in range(12)]
    rows = []
    for doc_id in range(40):
        rows.append((doc_id, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 1, 1, 2, 3])) for _ in range(4))))
    got = dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], i) for r in got for i in r["dropped"]} == brute(rows)


@pytest.mark.parametrize("hot", [16, 1])
def test_lines_of_templates(spark, monkeypatch, hot):
    """Lines that share most of their text, with numbers at an end, inside, or at two places."""
    monkeypatch.setattr(linededup, "HOT", hot)
    monkeypatch.setattr(linededup, "HEAVY", 20)
    rng = random.Random(7)
    made = []
    for _ in range(70):
        a, b = rng.randrange(10**6), rng.randrange(500)
        made += [f"Record of the old city archive, file {a:06d}", f"{b:05d} is the number of this old record", f"user {b:03d} came back on day {a % 30:02d} of the month"]
    made += [edited(rng, line, rng.choice([1, 2, 3])) for line in rng.sample(made, 90)]
    rng.shuffle(made)
    rows = [(i, "\n".join(made[i * 5 : i * 5 + 5])) for i in range(len(made) // 5)]
    got = dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], i) for r in got for i in r["dropped"]} == brute(rows)


def test_odd_rows(spark):
    line = "a line of some thirty characters"
    rows = [(None, line, "x"), (1, None, "y"), (2, "", None), (3, f"short\n{line}!", "z"), (4, f"{line}\nand another line with other words", None)]
    rows += [(5, "one more quite ordinary line here", "d")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped string")
    got = sorted(map(tuple, dedup_documents(docs).collect()), key=repr)
    want = [(None, line, "x"), (1, None, "y"), (2, "", None), (4, "and another line with other words", None)]
    want += [(5, "one more quite ordinary line here", "d")] * 2
    assert got == sorted(want, key=repr)
    assert dedup_documents(docs.limit(0)).count() == 0
