"""Merkle manifest of a table: a tree per source under one root, with proofs by pointer jumping.

Leaves are ranked without a sort in one task: the table is sorted by range of (source, doc_id, leaf),
and a position is the line's place in its partition plus the lines before that partition. Each run of
16 consecutive nodes then becomes its parent, level by level, in all sources at once; every level has a
sixteenth of the rows of the one below. The subroots are leaves of a tree of the same kind.

Proofs: every node above the leaves starts with a pointer to its parent and the segment of its
siblings' digests on both sides. A self-join replaces a pointer by the pointer of the node it points at
and joins the segments, which doubles the distance, until all pointers have reached the root. A leaf
takes its last jump from its run, whose row holds the run's leaves, so the long proofs are never
repeated per leaf in a shuffle. Pointers that have arrived leave the join: the root is no hot key.

Memory: a run holds at most 16 nodes and a proof grows with the logarithm of the rows. A hot source is
spread by its positions. Joins on a source or ancestor are broadcast only below `FEW` counted rows.

Defined cases: rows without an id come first in their source, rows with equal ids follow the order of
their leaves, and equal rows are separate leaves. A null source is a source of its own, before all others.
Null and empty values differ (`-` and `0:`). A single row is subroot and root at once, its proof
empty. An empty table gives an empty result. Texts of any length are one hash each. Other columns take
no part, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.llm.common import register, table, write_shared

FANOUT = 16
FEW = 2_000  # rows that are broadcast
TOP = -1  # number of the tree above the sources
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]  # the fixed order of a leaf


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return digest(*[framed(v) for v in values])


def few(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The written table with `at`, each row's place in `order`, from 0."""
    # Equal rows get a number, so that no value fills a partition of its own.
    df = write_shared(df.withColumn("_u", F.monotonically_increasing_id()), name)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    lines = df.repartitionByRange(parts, *order, "_u").sortWithinPartitions(*order, "_u").drop("_u")
    lines = write_shared(lines.withColumn("_m", F.monotonically_increasing_id()), f"{name}-sorted")
    lines = lines.withColumn("_p", F.shiftright("_m", 33))
    counts = lines.groupBy("_p").agg(F.min("_m").alias("_low"), F.count("*").alias("_n"))
    # One row per partition.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = lines.join(F.broadcast(starts), "_p")
    return placed.withColumn("at", F.col("_before") + F.col("_m") - F.col("_low")).drop("_p", "_m", "_low", "_before")


def grown(nodes: DataFrame, level: int) -> DataFrame:
    """Parents (tree, level, i, n, digest, children) of the nodes of trees with several nodes on `level`.

    `nodes` has tree, i (place in its level), n (nodes of that level of the tree), digest and `self`,
    the (tree, level, i) by which pointers know the node.
    """
    run = F.floor(F.col("i") / FANOUT).alias("i")
    child = F.struct(F.col("i").alias("at"), "digest", "self")
    runs = nodes.filter("n > 1").groupBy("tree", run).agg(
        F.array_sort(F.collect_list(child)).alias("children"), F.first("n").alias("below")
    )
    return runs.select(
        "tree", F.lit(level + 1).alias("level"), "i", F.ceil(F.col("below") / FANOUT).alias("n"),
        F.sha2(F.array_join("children.digest", ""), 256).alias("digest"), "children",
    )


def with_self(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("self", F.struct("tree", "level", "i"))


def levels(nodes: DataFrame, level: int, name: str) -> list[DataFrame]:
    """The written levels above `nodes`, up to single nodes."""
    out = []
    while nodes.filter("n > 1").limit(1).count():
        nodes = with_self(write_shared(grown(nodes, level), f"{name}-{level + 1}"))
        out.append(nodes)
        level += 1
    return out


def sides(children: Column, place: Column) -> Column:
    """The digests left and right of a child of a run, joined."""
    return F.struct(
        F.array_join(F.slice(children, F.lit(1), place), "").alias("l"),
        F.array_join(F.slice(children, place + 2, F.lit(FANOUT)), "").alias("r"),
    )


def pointers(parents: DataFrame) -> DataFrame:
    """(node, above, path): from each child to its parent, with the segment of its siblings."""
    child = parents.select("self", F.col("children.digest").alias("digests"), F.posexplode("children").alias("k", "child"))
    return child.select(
        F.col("child.self").alias("node"), F.col("self").alias("above"), F.array(sides(F.col("digests"), F.col("k"))).alias("path")
    )


def jumped(links: DataFrame, root: Column, depth: int) -> DataFrame:
    """(node, path) with the whole path to the root, after the logarithm of `depth` self-joins."""
    links = write_shared(links, "pointers")
    distance = 1
    while distance < depth:
        done = F.col("above") == root
        # What lies `distance` above any node of the same tree, or in the tree of the subroots.
        target = links.filter((F.col("node.tree") == TOP) | (F.col("node.level") > distance))
        target = target.select(F.col("node").alias("above"), F.col("above").alias("next"), F.col("path").alias("further"))
        # A pointer table shrinks by 16 ** distance per jump: soon a broadcast.
        moved = links.filter(~done).join(few(target), "above").select("node", F.col("next").alias("above"), F.concat("path", "further").alias("path"))
        links = write_shared(moved.union(links.filter(done)), "pointers")
        distance *= 2
    return links.select("node", "path")


def manifest(leaves: DataFrame) -> DataFrame:
    """(row, leaf, tampered, subroot, root, path) of every leaf.

    `leaves` has source, doc_id, leaf, tampered (leaves recomputed later, say) and row, which is handed
    through. `path` lists the sibling digests (l, r: left and right of the node) from leaf to root.
    """
    spark = leaves.sparkSession
    placed = ranked(leaves, ["source", "doc_id", "leaf"], "leaves")
    # A source's tree is known by the place of its first leaf, so trees come in the order of sources.
    sources = write_shared(placed.groupBy("source").agg(F.min("at").alias("tree"), F.count("*").alias("n")), "sources")
    known = few(sources.withColumnRenamed("source", "_s"))
    held = placed.join(known, F.col("source").eqNullSafe(F.col("_s"))).withColumn("i", F.col("at") - F.col("tree"))
    run = F.floor(F.col("i") / FANOUT).alias("i")
    leaf = F.struct("i", "leaf", "tampered", "row")
    runs = held.groupBy("tree", run).agg(F.array_sort(F.collect_list(leaf)).alias("leaves"), F.first("n").alias("below"))
    lone = F.col("below") == 1
    run_digest = F.when(lone, F.col("leaves")[0]["leaf"]).otherwise(F.sha2(F.array_join("leaves.leaf", ""), 256))
    runs = write_shared(
        runs.select(
            "tree", F.when(lone, 0).otherwise(1).alias("level"), "i", F.ceil(F.col("below") / FANOUT).alias("n"),
            run_digest.alias("digest"), "leaves",
        ),
        "runs",
    )
    nodes = with_self(runs.drop("leaves"))
    inner = levels(nodes, 1, "level")
    tops = nodes.filter("n = 1").select("tree", "digest", "self")
    for upper in inner:
        tops = tops.union(upper.filter("n = 1").select("tree", "digest", "self"))
    subroots = write_shared(tops, "subroots")
    count = subroots.count()
    none = F.array().cast("array<struct<l:string,r:string>>")
    if not count:
        return placed.select("row", "leaf", "tampered", F.lit("").alias("subroot"), F.lit("").alias("root"), none.alias("path"))
    base = ranked(subroots, ["tree"], "subroots").select(
        F.lit(TOP).cast("long").alias("tree"), F.col("at").alias("i"), F.lit(count).cast("long").alias("n"), "digest", "self"
    )
    outer = levels(base, 0, "top")
    last = (outer[-1] if outer else subroots).select("digest", "self").first()
    links = None
    for parents in inner + outer:
        found = pointers(parents)
        links = found if links is None else links.union(found)
    if links is None:
        paths = spark.createDataFrame([], "node struct<tree:long,level:int,i:long>, path array<struct<l:string,r:string>>")
    else:
        root = F.struct(*[F.lit(last["self"][k]).cast(t).alias(k) for k, t in (("tree", "long"), ("level", "int"), ("i", "long"))])
        paths = jumped(links, root, len(inner) + len(outer))
    told = with_self(runs).join(paths.withColumnRenamed("node", "self"), "self", "left")
    told = told.join(few(subroots.select("tree", F.col("digest").alias("subroot"))), "tree")
    each = told.select(
        "level", "subroot", F.coalesce("path", none).alias("path"), F.col("leaves.leaf").alias("digests"), F.posexplode("leaves").alias("k", "it")
    )
    own = F.when(F.col("level") == 0, none).otherwise(F.array(sides(F.col("digests"), F.col("k"))))
    return each.select(
        "it.row", "it.leaf", "it.tampered", "subroot", F.lit(last["digest"]).alias("root"), F.concat(own, F.col("path")).alias("path")
    )


def proof_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["l"], acc, s["r"]))


def _oracle(depth: int = 8) -> str:
    """The same tree level by level; a level of single nodes changes nothing, so any depth is enough that reaches the root."""
    crc_step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte_step = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {crc_step})"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda t: CAST(ascii(t) AS BIGINT))"
    crc = f"xor(list_reduce(list_concat([4294967295], {digits}), lambda c, b: {byte_step}), 4294967295)"
    cells = {c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS}
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    changed = cells | {"text": f"coalesce(strlen({lowered}) || ':' || {lowered}, '-')"}
    parts = [
        f"""leaves AS (SELECT doc_id, source AS s, sha256({" || ".join(cells.values())}) AS leaf,
        CASE WHEN {crc} % 5 = 0 THEN sha256({" || ".join(changed.values())}) END AS changed FROM documents)""",
        """ranked AS (SELECT row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n,
        s, leaf, doc_id, coalesce(changed, leaf) AS f FROM leaves)""",
        "l0 AS (SELECT s, i, n, leaf AS h FROM ranked)",
        "a0 AS (SELECT s, i, doc_id, leaf, f, '' AS proof FROM ranked)",
    ]

    def climb(tree: str, rows: str) -> None:
        """Levels tree1.. of the nodes in tree0, and the leaves' fold and proof rows1.. along them."""
        for k in range(depth):
            run = f"OVER (PARTITION BY s, i // {FANOUT} ORDER BY i ROWS BETWEEN"
            parts.append(f"""{tree}s{k} AS (SELECT s, i, n, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {tree}{k})""")
            parts.append(f"""{tree}{k + 1} AS (SELECT s, i // {FANOUT} AS i, (max(n) + {FANOUT - 1}) // {FANOUT} AS n,
            CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {tree}{k} GROUP BY s, i // {FANOUT})""")
            parts.append(f"""{rows}{k + 1} AS (SELECT a.* REPLACE (a.i // {FANOUT} AS i, CASE WHEN x.n > 1 THEN sha256(l || f || r) ELSE f END AS f,
            CASE WHEN x.n > 1 THEN proof || l || r ELSE proof END AS proof)
            FROM {rows}{k} a JOIN {tree}s{k} x ON a.s IS NOT DISTINCT FROM x.s AND a.i = x.i)""")

    climb("l", "a")
    parts.append(f"t0 AS (SELECT 0 AS s, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, s AS source FROM l{depth})")
    parts.append(f"b0 AS (SELECT 0 AS s, t0.i, a.doc_id, a.leaf, t0.h AS subroot, a.f, a.proof FROM a{depth} a JOIN t0 ON a.s IS NOT DISTINCT FROM t0.source)")
    climb("t", "b")
    return f"""WITH {", ".join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified
    FROM b{depth} JOIN (SELECT h FROM t{depth}) ON true"""


@register("op13_merkle_manifest", _oracle())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    doc_id = F.col("doc_id").cast("long")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(doc_id.cast("string")) % 5 == 0
    leaves = docs.select(
        "source", doc_id.alias("doc_id"), leaf_of([F.col(c) for c in FIELDS]).alias("leaf"),
        F.when(hit, leaf_of([F.col(c) for c in FIELDS[:-1]] + [lowered])).alias("changed"),
    )
    leaves = leaves.select("source", "doc_id", "leaf", F.coalesce("changed", "leaf").alias("tampered"), F.struct("doc_id").alias("row"))
    found = manifest(leaves).withColumn("folded_root", folded(F.col("tampered"), F.col("path")))
    return found.select(
        "row.doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
