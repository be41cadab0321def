"""Line dedup with a segment-partition edit join.

A line of at least `MIN_CHARS` characters goes if an earlier line of the corpus equals it or is within
`EDITS` edits of it; the first one stays. Lines stand in the order of doc_id, text hash and line
number. With `short`, shorter lines ("Home") go if an earlier line equals them; blank ones never do.

The join, over distinct lines: a line is cut into EDITS + 1 segments, so a line within EDITS edits
holds at least one of them unchanged, at a place that the two lengths allow. Segments are
indexed by (length, number, text); every line probes the indexes of its own and the two shorter
lengths with the substrings that the multi-match rule selects. Pairs that meet are verified: common
ends are cut off, and a banded bit-parallel edit distance runs over the rest, one machine word of
2 * EDITS + 1 bits a character.

A segment shared by many distinct lines (a template) would make all their pairs. Under such a key
(more than `HOT` lines) the partition is applied again to what the key leaves open: the parts beside the
matched segment, each with the edits that may still lie in it. The open part in which the key's lines
differ most is cut into as many segments as it may hold edits, and one more; the cuts are laid so that
every segment holds some of the characters in which those lines differ. This goes on until a key has at most
`HOT` lines, or until its lines differ only within as many characters as may be edited; what such keys
still share falls into blocks of about `HOT` lines, spread by key and block, and each probe searches every block.

Only built-in expressions are used. Texts travel once, to become distinct; what follows moves 64-bit
hashes. Texts of candidates are read again through a bitmap of fixed size, broadcast as at most
2**WORD_BITS rows; false alarms only cost work, since texts are compared in the end.

Defined cases: a null text has no lines; equal rows count as one occurrence and are treated alike;
a null id comes first; an empty table gives an empty result; other columns are untouched, whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import register, table, write_shared

EDITS = 2  # `cut_again` knows parts of one and of two edits
MIN_CHARS = 20
HOT = 16
HEAVY, SPREAD = 10_000, 16  # rows below a key of more than HEAVY lines meet their key's figures in SPREAD parts
WORD_BITS = 16
WORDY = r"[\p{L}\p{N}]"
PLACE = ("doc_id", "text_hash", "line_no")


def lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """doc_id, text_hash, line_no (from 0), line: every line long enough to be judged, or all but blank ones."""
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    )
    judged = F.length("line") >= MIN_CHARS
    return cut.filter(judged | F.col("line").rlike(r"[^\s]") if short else judged)


def hashed(found: DataFrame) -> DataFrame:
    """Adds a 128-bit key of the line, k1 and k2."""
    return found.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), "line")})


def segment(size: Column, number: int) -> tuple[Column, Column]:
    """Start (from 0) and length of a segment of a line of `size` characters."""
    start = F.floor(size * number / (EDITS + 1))
    return start, F.floor(size * (number + 1) / (EDITS + 1)) - start


def probes() -> list[tuple[int, int, int]]:
    """(how much shorter the indexed line is, segment number, shift) of every substring to probe."""
    found = []
    for shorter in range(EDITS + 1):
        for i in range(1, EDITS + 2):
            low = max(-(i - 1), shorter - (EDITS + 1 - i))
            high = min(i - 1, shorter + (EDITS + 1 - i))
            found += [(shorter, i - 1, shift) for shift in range(low, high + 1)]
    return found


def segment_keys(distinct: DataFrame, indexed: bool) -> DataFrame:
    """(id, key, probe) of all distinct lines: their own segments, else also all probes, by their number in `probes`."""
    # Each segment and its surroundings are cut out of the line once; the probes then cut from these.
    sized = distinct.withColumn("n", F.length("line").cast("long"))
    around = {}
    for i in range(EDITS + 1):
        low = F.greatest(segment(F.col("n") - EDITS, i)[0] - EDITS, F.lit(0)).cast("int")
        size = (F.floor(F.col("n") * (i + 1) / (EDITS + 1)) + EDITS).cast("int") - low
        around |= {f"low{i}": low, f"around{i}": F.substring("line", low + 1, size)}
    rows = []
    for place, (shorter, number, shift) in enumerate(probes()):
        own = shorter == 0 and shift == 0
        if own or not indexed:
            length = F.col("n") - shorter
            start, width = segment(length, number)
            first = (start + shift + 1).cast("int") - F.col(f"low{number}")
            cut = F.substring(f"around{number}", first, width.cast("int"))
            key = F.xxhash64(length, F.lit(number), cut)
            rows.append(F.struct(key.alias("key"), F.lit(place).cast("byte").alias("probe")))
    return sized.withColumns(around).select(F.xxhash64("line").alias("id"), F.explode(F.array(*rows)).alias("x")).select("id", "x.*")


def let(fields: dict[str, Column], then) -> Column:
    """`then` over a struct of values, each computed once a row however often it is used."""
    return F.transform(F.array(F.struct(*[c.alias(k) for k, c in fields.items()])), then)[0]


def longest_common(a: Column, b: Column) -> Column:
    """Length of the common prefix, found by doubling steps from large to small."""
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])

    def search(s: Column) -> Column:
        def grow(done: Column, step: Column) -> Column:
            same = F.substring(s["a"], done + 1, step) == F.substring(s["b"], done + 1, step)
            return F.when(done + step > s["most"], done).when(same, done + step).otherwise(done)

        return F.aggregate(steps, F.lit(0), grow)

    return let({"a": a, "b": b, "most": F.least(F.length(a), F.length(b))}, search)


def banded(pattern: Column, text: Column, edits: int = EDITS) -> Column:
    """Edit distance of two arrays of characters, the pattern not the shorter; edits + 1 if above.

    Bit d of a word stands for pattern character j - edits + d beside text character j.
    """
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (2 * edits)
    turn = F.size(pattern) - edits  # from here the last row of the band is followed sideways
    start = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"))

    def step(state: Column, j: Column) -> Column:
        here = F.get(text, j)
        match = F.lit(0)
        for d in range(width):
            place = j - edits + d
            match = match + F.when(F.get(pattern, place) == here, 1 << d).otherwise(0)
        vp, vn = state["vp"], state["vn"]
        d0 = (match.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(match).bitwiseOR(vn).bitwiseAND(F.lit(full))
        made = F.transform(F.array(F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"), state["d"].alias("d"))), after(j))
        return F.when(state["d"] > 2 * edits, state).otherwise(made[0])

    def after(j: Column):
        def build(s: Column) -> Column:
            d0 = s["d0"]
            hp = s["vn"].bitwiseOR(F.lit(full) - d0.bitwiseOR(s["vp"]))
            hn = d0.bitwiseAND(s["vp"])
            bit = F.lit(2 * edits - 1) - (j - F.greatest(turn, F.lit(0)))
            mask = F.call_function("shiftleft", F.lit(1), F.greatest(bit, F.lit(0)).cast("int"))
            side = (hp.bitwiseAND(mask) > 0).cast("int") - (hn.bitwiseAND(mask) > 0).cast("int")
            down = (d0.bitwiseAND(F.lit(top)) == 0).cast("int")
            moved = F.when(j < turn, down).when(bit >= 0, side).otherwise(0)
            half = F.shiftright(d0, 1)
            vp = hn.bitwiseOR(F.lit(full) - half.bitwiseOR(hp).bitwiseAND(F.lit(full)))
            return F.struct(vp.alias("vp"), half.bitwiseAND(hp).alias("vn"), (s["d"] + moved).alias("d"))

        return build

    return F.least(F.aggregate(F.sequence(F.lit(0), F.size(text) - 1), start, step)["d"], F.lit(edits + 1))


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two lines, both longer than `edits`, are within `edits` edits; as few as needed is read."""

    def trimmed(s: Column) -> Column:
        tail = longest_common(
            F.reverse(F.substring(s["x"], s["p"] + 1, F.length(s["x"]))),
            F.reverse(F.substring(s["y"], s["p"] + 1, F.length(s["y"]))),
        )
        return let({"x": s["x"], "y": s["y"], "p": s["p"], "q": tail}, compared)

    def compared(s: Column) -> Column:
        # What is left stays longer than the band's half, which trimming less ensures.
        room = F.length(s["y"]) - s["q"] - (edits + 1)
        p = F.greatest(F.lit(0), F.least(s["p"], room))
        q = F.greatest(F.lit(0), F.least(s["q"], F.length(s["y"]) - p - (edits + 1)))

        def middle(t: Column) -> Column:
            return F.split(F.substring(t, p + 1, F.length(t) - p - q), "")

        return let({"x": middle(s["x"]), "y": middle(s["y"])}, lambda m: banded(m["x"], m["y"], edits) <= edits)

    near = F.abs(F.length(a) - F.length(b)) <= edits
    ordered = {"x": F.when(F.length(a) >= F.length(b), a).otherwise(b), "y": F.when(F.length(a) >= F.length(b), b).otherwise(a)}
    return near & let(ordered, lambda s: let({"x": s["x"], "y": s["y"], "p": longest_common(s["x"], s["y"])}, trimmed))


def only(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows whose `name` may be among `ids` (id): a bitmap of 2**(WORD_BITS + 6) bits, broadcast."""
    place = F.xxhash64("id")
    words = ids.select(
        F.pmod(F.shiftright(place, 6), F.lit(1 << WORD_BITS)).alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("bit"),
    )
    words = words.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    own = F.xxhash64(name)
    kept = rows.withColumn("word", F.pmod(F.shiftright(own, 6), F.lit(1 << WORD_BITS))).join(F.broadcast(words), "word")
    hit = F.call_function("getbit", F.col("bits"), F.pmod(own, F.lit(64)).cast("int")) == 1
    return kept.filter(hit).drop("word", "bits")


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of line ids that share a key, and rows (id, key, role, probe, n) of keys with many lines.

    Role 1 marks a line's own segment, which the key holds too, role 2 a mere probe.
    """
    distinct = lines(docs).select("line").distinct()
    index = segment_keys(distinct, True).select("key", F.col("id").alias("held"))
    sizes = index.groupBy("key").agg(F.count("*").alias("n"))
    owned = [i for i, (shorter, _, shift) in enumerate(probes()) if shorter == 0 and shift == 0]
    role = F.when(F.col("probe").isin(owned), 1).otherwise(2).cast("byte")
    sized = segment_keys(distinct, False).join(sizes, "key").withColumn("role", role)
    return meet(sized.filter(f"n <= {HOT}"), index), sized.filter(f"n > {HOT}")


def meet(rows: DataFrame, index: DataFrame, near: Column | None = None) -> DataFrame:
    """(a, b): every row's id with the ids that its key holds, where `near` allows."""
    met = rows.join(index, "key").filter("held < id or (role = 2 and held <> id)")
    met = met if near is None else met.filter(near)
    return met.select(F.least("id", "held").alias("a"), F.greatest("id", "held").alias("b"))


def opened(hot: DataFrame, texts: DataFrame) -> DataFrame:
    """What a hot key leaves open of its lines: key, role, id, above (lines of the key) and `parts`.

    A part holds its text `t`, the length `w` that it has in the indexed lines, and the edits `x` that may lie in it.
    """
    known = [F.element_at(F.array(*[F.lit(v) for v in values]), F.col("probe").cast("int") + 1) for values in zip(*probes())]
    shorter, number, shift = known
    size = F.length("line") - shorter
    start, width = segment(size, number)
    parts = F.array(
        part(F.substring("line", F.lit(1), (start + shift).cast("int")), start, number),
        part(F.substring("line", (start + shift + width + 1).cast("int"), F.length("line")), size - start - width, F.lit(EDITS) - number),
    )
    rows = hot.join(texts.select(F.col("k1").alias("id"), "line"), "id")
    return rows.select("key", "role", "id", F.col("n").alias("above"), F.filter(parts, lambda p: p["x"] > 0).alias("parts"))


def part(text: Column, width: Column, edits: Column) -> Column:
    return F.struct(text.alias("t"), width.cast("int").alias("w"), edits.cast("int").alias("x"))


def differing(rows: DataFrame) -> DataFrame:
    """For every key that two rows meet in: n lines, the part `pick` in which they differ most, `open` characters after `skip` equal ones.

    The least and the greatest of some texts share just the beginning that all of them share.
    """
    own = F.col("role") == 1
    found = [F.count(F.when(own, 1)).alias("n"), F.count("*").alias("rows"), F.max("above").alias("above")]
    for i in range(EDITS):
        text = F.when(own, F.get("parts", F.lit(i))["t"])
        found += [F.min(text).alias(f"low{i}"), F.max(text).alias(f"high{i}")]
        found += [F.min(F.reverse(text)).alias(f"back_low{i}"), F.max(F.reverse(text)).alias(f"back_high{i}")]
    keys = rows.groupBy("key").agg(*found).filter("n > 0 and rows > 1")
    best = []
    for i in range(EDITS):
        skip = longest_common(F.col(f"low{i}"), F.col(f"high{i}"))
        tail = longest_common(F.col(f"back_low{i}"), F.col(f"back_high{i}"))
        width = F.greatest(F.coalesce(F.length(f"low{i}"), F.lit(0)) - skip - tail, F.lit(0))
        best.append(F.struct(width.alias("open"), F.lit(-i).alias("order"), skip.alias("skip")))
    keys = keys.select("key", "n", "above", F.array_max(F.array(*best)).alias("best"))
    return keys.select("key", "n", "above", (-F.col("best.order")).alias("pick"), "best.open", "best.skip")


def cut_again(rows: DataFrame) -> DataFrame:
    """Every row's part `pick` in segments: rows of the keys one level down, as `opened` gives them.

    The cuts count from the indexed text, so all rows of a key agree on them; a probe looks for a segment at
    every shift that leaves either side with as many edits as it may hold.
    """
    chosen, other = F.get("parts", F.col("pick")), F.get("parts", 1 - F.col("pick"))
    longer = F.length(chosen["t"]) - chosen["w"]
    steps = [(F.lit(0), F.lit(0)), (chosen["x"], longer)] + [(F.lit(1), F.lit(t)) for t in range(1 - EDITS, EDITS)]
    steps = F.array(*[F.struct(j.cast("int").alias("j"), t.cast("int").alias("shift")) for j, t in steps])
    inner = F.filter(steps, lambda s, i: (i < 2) | ((chosen["x"] == EDITS) & (F.abs(s["shift"] - longer) <= 1)))
    stepped = rows.select("key", "role", "id", "n", "open", "skip", chosen.alias("p"), other.alias("other"), F.explode(inner).alias("s"))

    j, shift, edits, text = F.col("s.j"), F.col("s.shift"), F.col("p.x"), F.col("p.t")
    start = F.when(j == 0, 0).otherwise(F.col("skip") + F.floor(F.col("open") * j / (edits + 1))).cast("int")
    end = F.when(j == edits, F.col("p.w")).otherwise(F.col("skip") + F.floor(F.col("open") * (j + 1) / (edits + 1))).cast("int")
    placed = stepped.withColumns({"start": start, "end": end})
    start, end = F.col("start"), F.col("end")
    parts = F.array(
        part(F.substring(text, F.lit(1), start + shift), start, j),
        part(F.substring(text, end + shift + 1, F.length(text)), F.col("p.w") - end, edits - j),
        F.col("other"),
    )
    return placed.select(
        F.xxhash64("key", j, F.substring(text, start + shift + 1, end - start)).alias("key"),
        F.when((F.col("role") == 1) & (shift == 0), 1).otherwise(2).cast("byte").alias("role"),
        "id", F.col("n").alias("above"), F.filter(parts, lambda p: p.isNotNull() & (p["x"] > 0)).alias("parts"),
    )


def odd_characters(parts: Column) -> Column:
    """64 bits, by hash: which characters occur an odd number of times. One edit turns at most two of them."""
    text = F.array_join(F.transform(parts, lambda p: p["t"]), "")
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def turned(bits: Column, char: Column) -> Column:
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(char), F.lit(64)).cast("int")))

    return F.aggregate(chars, F.lit(0).cast("long"), turned)


def refined(rows: DataFrame) -> DataFrame:
    """(key, role, id, n, odd): keys with few lines, or with lines that differ only where edits may lie, from `opened` rows."""
    done = []
    while True:
        salts = F.when(F.col("above") > HEAVY, SPREAD).otherwise(1)
        keys = differing(rows).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("above")
        met = rows.withColumn("salt", F.pmod(F.col("id"), salts).cast("int")).join(keys, ["key", "salt"])
        more = (F.col("n") > HOT) & (F.col("open") > F.get("parts", F.col("pick"))["x"])
        met = met.withColumn("more", more).withColumn("odd", F.when(~F.col("more"), odd_characters(F.col("parts"))))
        met = met.withColumn("parts", F.when(F.col("more"), F.col("parts")))
        met = write_shared(met.drop("salt", "above"), "open-segments")
        done.append(met.filter("not more").select("key", "role", "id", "n", "odd"))
        rest = met.filter("more")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        rows = write_shared(cut_again(rest), "cut-again")


def near_links(docs: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2): keys of the distinct lines within EDITS edits of each other, each pair once."""
    pairs, hot = candidates(docs)
    marked = hot.select(F.col("id").alias("a"), "key", "role", "probe", "n")
    both = write_shared(pairs.unionByName(marked, allowMissingColumns=True), "candidates")
    pairs, hot = both.filter("key is null").select("a", "b"), both.filter("key is not null").withColumnRenamed("a", "id").drop("b")

    needed = both.select(F.col("a").alias("id")).union(both.select("b").filter("b is not null")).distinct()
    texts = only(hashed(lines(docs).select("line")), needed, "k1").distinct()
    texts = write_shared(texts, "candidate-lines")

    # Hot keys, cut again: the few lines of a key meet like others, many equal but for their last edits go on.
    rest = refined(opened(hot, texts))
    few = rest.filter(f"n <= {HOT}")
    index = few.filter("role = 1").select("key", F.col("id").alias("held"), F.col("odd").alias("held_odd"))
    near = F.bit_count(F.col("odd").bitwiseXOR(F.col("held_odd"))) <= 2 * EDITS
    pairs = pairs.unionByName(meet(few, index, near)).distinct()
    hot = rest.filter(f"n > {HOT}")

    def side(name: str) -> DataFrame:
        return texts.select(F.col("k1").alias(name), F.struct("k1", "k2", "line").alias(f"t{name}"))

    cool = pairs.join(side("a"), "a").join(side("b"), "b").filter(within(F.col("ta.line"), F.col("tb.line")))
    cool = cool.select("ta.k1", "ta.k2", F.col("tb.k1").alias("o1"), F.col("tb.k2").alias("o2"))

    full = hot.join(texts, hot["id"] == texts["k1"]).drop("id")
    blocks = F.ceil(F.col("n") / HOT)
    block = F.pmod(F.xxhash64("k2"), blocks)
    held = full.filter("role = 1").groupBy("key", block.alias("block")).agg(F.collect_list(F.struct("k1", "k2", "line")).alias("held"))
    met = full.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).join(held, ["key", "block"])

    def other(h: Column) -> Column:
        later = (h["k1"] > F.col("k1")) | ((h["k1"] == F.col("k1")) & (h["k2"] > F.col("k2")))
        return later | ((F.col("role") == 2) & ((h["k1"] != F.col("k1")) | (h["k2"] != F.col("k2"))))

    close = F.filter("held", lambda h: other(h) & within(F.col("line"), h["line"]))
    links = F.transform(close, lambda h: F.struct(h["k1"].alias("o1"), h["k2"].alias("o2")))
    warm = met.select("k1", "k2", F.explode(links).alias("o")).select("k1", "k2", "o.*")

    first = F.struct("k1", "k2") < F.struct("o1", "o2")
    names = {"a1": F.when(first, F.col("k1")).otherwise(F.col("o1")), "a2": F.when(first, F.col("k2")).otherwise(F.col("o2"))}
    names |= {"b1": F.when(first, F.col("o1")).otherwise(F.col("k1")), "b2": F.when(first, F.col("o2")).otherwise(F.col("k2"))}
    return cool.unionByName(warm).select(*[c.alias(k) for k, c in names.items()]).distinct()


def dropped_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """doc_id, text_hash and, for each document with lines to drop, `dropped` (numbers) and `near`.

    With `short`, lines below MIN_CHARS are judged too, by equality; the edit join keeps to the others.
    """
    docs = docs.select("doc_id", "text")
    seen = write_shared(hashed(lines(docs, short)).drop("line"), "lines")
    links = write_shared(near_links(docs), "links")
    place = F.struct(*PLACE)

    # The first place of every linked line, then the later line of every link.
    ends = links.select(F.explode(F.array(F.struct(F.col("a1").alias("k1"), F.col("a2").alias("k2")), F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2")))).alias("e")).select("e.*").distinct()
    linked = only(seen, ends.select(F.col("k1").alias("id")), "k1").join(ends, ["k1", "k2"], "left_semi")
    firsts = linked.groupBy("k1", "k2").agg(F.min(place).alias("first"))

    def end(name: str) -> DataFrame:
        return firsts.select(F.col("k1").alias(f"{name}1"), F.col("k2").alias(f"{name}2"), F.col("first").alias(f"{name}_first"))

    paired = links.join(end("a"), ["a1", "a2"]).join(end("b"), ["b1", "b2"])
    later = F.col("a_first") < F.col("b_first")
    near = paired.select(
        F.when(later, F.col("b1")).otherwise(F.col("a1")).alias("k1"), F.when(later, F.col("b2")).otherwise(F.col("a2")).alias("k2")
    ).distinct()

    repeated = seen.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    judged = repeated.join(near.withColumn("near", F.lit(True)), ["k1", "k2"], "full")
    marked = seen.join(judged, ["k1", "k2"]).withColumn("near", F.coalesce("near", F.lit(False)))
    gone = marked.filter(F.col("near") | (place != F.col("first")))
    return gone.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set("line_no")).alias("dropped"), F.count_distinct(F.when(F.col("near"), F.col("line_no"))).alias("near")
    )


def dedup_documents(docs: DataFrame, short: bool = False) -> DataFrame:
    """The documents without their dropped lines. Same columns.

    Of the documents that lose lines, those left without a line of MIN_CHARS characters go; with
    `short`, short lines are judged too, and only documents without a letter or digit left go.
    """
    gone = dropped_lines(docs, short).withColumnRenamed("doc_id", "gone_id").withColumnRenamed("text_hash", "gone_hash")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("h"))
    same = (F.col("h") == F.col("gone_hash")) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("gone_id"))
    joined = packed.join(gone, same, "left")
    parts = F.split("row.text", "\n")
    left = F.filter(parts, lambda line, i: ~F.array_contains(F.coalesce("dropped", F.array().cast("array<int>")), i))
    joined = joined.withColumn("left", left)
    bare = F.col("dropped").isNotNull() & ~F.exists("left", lambda line: line.rlike(WORDY) if short else F.length(line) >= MIN_CHARS)
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join("left", "\n"))
    joined = joined.filter(~bare).withColumn("kept_text", text)
    out = []
    for c in docs.columns:
        column = F.col("row").getField(c)
        if c == "text":
            column = F.col("kept_text")
        elif c == "n_chars":
            column = F.length("kept_text").cast("long")
        out.append(column.alias(c))
    return joined.select(*out)


@register("op3_line_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_near (dropped for a near line) and the numbers of the dropped lines."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"))
    gone = dropped_lines(docs, short=True).withColumnRenamed("doc_id", "gone_id")
    same = (counted["text_hash"] == gone["text_hash"]) & counted["doc_id"].eqNullSafe(gone["gone_id"])
    joined = counted.join(gone, same, "left")
    return joined.select(
        "doc_id", "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.array_join(F.transform("dropped", lambda i: i.cast("string")), ","), F.lit("")).alias("dropped_lines"),
    )
