"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits form 32 segments of two bits; the embedding is the number of set bits per
segment. One flipped bit moves one count by one, so the Manhattan distance of two embeddings is a
lower bound of the Hamming distance. Written as a thermometer code (00, 01, 11 per segment) the
embedding fits in one word, and the Manhattan distance is the number of differing code bits.

Grid range join: the segments form six groups. Counts that differ by three in all can touch three
groups at most, so linked fingerprints agree on all counts of some three groups. Every fingerprint
stands in one grid cell for each choice of three groups; pairs in a cell are tested by the Manhattan
bound and then exactly. Cells are cut into blocks, and each block pair answers with a spanning
forest of its links, so a cell of many close fingerprints never writes out its pairs.

Only distinct fingerprints are joined; copies hang on their fingerprint.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; fewer
than three words form one shingle; null ids take no part in the minimum; equal rows share the
result; an empty table gives an empty result; other columns are untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import register, slices, table, write_shared
from riskspark.llm.components import components

RADIUS = 3
GROUPS = 6  # cells agree on GROUPS - RADIUS of them
BLOCK = 2048
LOW = 0x5555555555555555  # the lower bit of every segment
SLICE = 1 << 16


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 hashes (seed 42) of all three-word shingles; signed 64-bit."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b" % w for w in zip(words, words[1:], words[2:])]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(shingles), SLICE):  # bounds the memory for very long texts
        found = np.array([digest(s, 42) for s in shingles[at : at + SLICE]], np.uint64)
        ones += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(shingles), bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprint(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(row: the named columns, fp) of every row."""
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "t")):
            found = pa.array([fingerprint(t) for t in batch.column("t").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), found], names=["row", "fp"])

    return plain.mapInArrow(run, f"row {plain.schema['row'].dataType.simpleString()}, fp long")


def thermometer(fp: F.Column) -> F.Column:
    """Per two-bit segment 00, 01 or 11: the popcount embedding in one word."""
    low = fp.bitwiseAND(F.lit(LOW))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def masks(groups: int = GROUPS, radius: int = RADIUS) -> list[int]:
    """For each choice of groups that must agree, the code bits of their segments, signed."""
    owner = [s * groups // 32 for s in range(32)]
    out = []
    for chosen in combinations(range(groups), groups - radius):
        mask = sum(3 << (2 * s) for s in range(32) if owner[s] in chosen)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def cells(fps: DataFrame) -> DataFrame:
    """(cell, fp): a row for every fingerprint and choice of agreeing groups."""
    code = thermometer(F.col("fp"))
    keys = [F.xxhash64(F.lit(i), F.col("code").bitwiseAND(F.lit(m))) for i, m in enumerate(masks())]
    coded = fps.select("fp", code.alias("code"))
    return coded.select("fp", F.explode(F.array(*keys)).alias("cell"))


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that span the links among `left`, or between `left` and `right`."""
    own = left if right is None else np.concatenate((left, right))
    bits = own.view(np.uint64)
    low = np.uint64(LOW)
    a, b = bits & low, (bits >> np.uint64(1)) & low
    code = a | b | ((a & b) << np.uint64(1))
    rows, from_col = len(left), 0 if right is None else len(left)
    i, j = np.nonzero(np.bitwise_count(code[:rows, None] ^ code[None, from_col:]) <= radius)
    j += from_col
    true = np.bitwise_count(bits[i] ^ bits[j]) <= radius
    i, j = i[true], j[true]
    root = np.arange(len(own))
    while True:
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, root[i])
        root = np.minimum(root, root[root])
        if (root == before).all():
            break
    hung = np.flatnonzero(root != np.arange(len(own)))
    return list(zip(own[hung].tolist(), own[root[hung]].tolist()))


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) spanning the links of distinct fingerprints `fps` (fp long)."""
    members = cells(fps)
    sizes = members.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    # A cell's members fall into blocks of about `block`; each pair of blocks is one piece of work.
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    work = (
        members.join(sizes, "cell").withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other)
        .select("cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp")
        .repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], axis=1)
            now = now if rest is None else np.concatenate((rest, now))
            starts = np.concatenate(([0], np.flatnonzero((now[1:, :3] != now[:-1, :3]).any(axis=1)) + 1))
            rest = now[starts[-1] :]
            yield solved(now[: starts[-1]], starts)
        if rest is not None:
            yield solved(rest, np.array([0, len(rest)]))

    def solved(rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        found: list[tuple[int, int]] = []
        for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            piece = rows[begin:end]
            if end - begin == 2 and piece[0, 1] == piece[0, 2]:
                x, y = int(piece[0, 4]), int(piece[1, 4])
                if ((x ^ y) & (2**64 - 1)).bit_count() <= RADIUS:
                    found.append((x, y))
            elif end - begin > 1:
                first = piece[piece[:, 3] == piece[0, 1], 4]
                second = None if piece[0, 1] == piece[0, 2] else piece[piece[:, 3] == piece[0, 2], 4]
                if second is None or (len(first) and len(second)):
                    found += forest(first, second)
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return work.mapInArrow(run, "a long, b long")


def with_component(rows: DataFrame) -> DataFrame:
    """Adds root and component_id to `rows` (fp long, doc_id long, ...), a written table."""
    # One line per fingerprint first: a third of all rows may share one.
    fps = write_shared(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(fps.select("fp")))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the smallest id. Same columns.

    A number written with each row tells equal ids and equal rows apart.
    """
    marked = with_fingerprint(docs, docs.columns).withColumn("uid", F.monotonically_increasing_id())
    marked = write_shared(marked, "marked")
    ids = marked.select("uid", F.col("row.doc_id").alias("doc_id"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")).alias("first")
    best = with_component(ids).groupBy("root").agg(first).select("first.uid")
    chosen = marked.join(best, "uid", "left_semi")
    return chosen.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


@register("op7_simhash_near_duplicates")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = with_fingerprint(docs, ["doc_id"]).select("row.doc_id", "fp")
    found = with_component(write_shared(rows, "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
