"""The Merkle manifest against plain recursion, on odd tables."""

import zlib
from hashlib import sha256
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from riskspark.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """(top, siblings per level of every node as (left, right)) of one tree."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 16, len(nodes))) for a in range(0, len(nodes), 16)]
        for run in runs:
            for i in run:
                sides = "".join(nodes[run[0] : i]), "".join(nodes[i + 1 : run[-1] + 1])
                for o in owners[i]:
                    paths[o].append(sides)
        nodes, owners = [h(*[nodes[i] for i in run]) for run in runs], [[o for i in run for o in owners[i]] for run in runs]
    return nodes[0], paths


def brute(rows):
    """Result rows of (doc_id, source, lang, n_chars, text) rows."""
    keyed = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    sources = [list(g) for _, g in groupby(keyed, key=lambda r: r[1])]
    trees = [climb([leaf(r) for r in rows]) for rows in sources]
    root, tops = climb([t[0] for t in trees]) if trees else ("", [])
    out = []
    for rows, (subroot, paths), above in zip(sources, trees, tops):
        for row, path in zip(rows, paths):
            path = path + above
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])
                changed = (*row[:4], lowered)
            fold = leaf(changed)
            for left, right in path:
                fold = h(left, fold, right)
            out.append((row[0], leaf(row), subroot, root, h(*[a + b for a, b in path]), fold, fold == root))
    return sorted(out, key=repr)


def run(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    extra = {"leaf": F.lit(1), "row": F.lit("x"), "i": F.lit(2.5), "path": F.lit("p"), "tree": F.lit(None).cast("int")}
    df.withColumns(extra).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in got.collect()], key=repr)


def doc(i, source, text="Some Text"):
    return (i, source, "en", len(text or ""), text)


CASES = {
    "empty": [],
    "one row": [doc(5, "a")],
    "one source of one run": [doc(i, "a", f"Text {i}") for i in range(16)],
    "one source": [doc(i, "a", f"Text {i}") for i in range(17)],
    "lone sources": [doc(i, f"s{i}", f"T{i}") for i in range(20)],
    "mixed": [
        *[doc(i, "hot", f"Text {i}") for i in range(300)],  # three levels
        *[doc(1000 + i, "b", f"B {i}") for i in range(16)],
        doc(2000, "lone"), doc(2001, None), doc(2002, None, None), doc(2003, ""),
        *[doc(3000 + i, f"é{i}", "Ünïcode TEXT 🎉") for i in range(18)],
    ],
    "odd": [
        *[(None, None, None, None, None)] * 20, *[doc(9, "a", "COPY")] * 40, doc(9, "a", "other"), doc(None, "a", "No id"),
        doc(-5, "a", ""), doc(10, "a", "LONG text " * 30_000), (7, "a", None, None, "-"), (7, "a", "-", None, None),
    ],
}


@pytest.mark.parametrize("name", CASES)
def test_against_recursion(spark, tmp_path, name):
    assert run(spark, CASES[name], tmp_path) == brute(CASES[name])


def test_joins_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "FEW", -1)
    assert run(spark, CASES["mixed"], tmp_path) == brute(CASES["mixed"])


def test_paths_verify_and_show_changes(spark):
    rows = [(f"s{i % 3}", i, merkle_leaf(i), merkle_leaf(i if i % 7 else -i), i) for i in range(200)]
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string, tampered string, row long")
    found = merkle.manifest(df).withColumns({c: merkle.folded(F.col(c), F.col("path")) for c in ("leaf", "tampered")}).collect()
    assert len(found) == 200 and {r["leaf"] for r in found} == {found[0]["root"]}
    assert all((r["tampered"] == r["root"]) == (r["row"] % 7 != 0 or r["row"] == 0) for r in found)


def merkle_leaf(i):
    return h(str(i))
