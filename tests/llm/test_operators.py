"""The llm operators against brute force on small, odd tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskspark.llm import bpe, langid, mixing, pii, quality, sharding, simhash, topk, urlmodel
from riskspark.llm.components import components

LONG = "one two three four five six seven eight nine ten " * 400
PASSAGE = " ".join(f"word{i} number{i * 7 % 13}" for i in range(400))
ROWS = [
    (1, "The quick brown fox\n\njumps  over <|endoftext|> it's 12 naïve", "a"),
    (2, None, None), (3, "", "b"), (4, LONG, "a"), (5, LONG + "!", None), (6, "日本語のテキスト 🎉 x", "c"),
    (7, PASSAGE, "b"), (8, "intro here. " + PASSAGE + " end", "b"), (None, "no id", "c"),
    (9, "mail a.b@c-d.org or 10.2.3.4 and 4111 1111 1111 1111, +1 (555) 123-4567", "a"),
    (9, "mail a.b@c-d.org or 10.2.3.4 and 4111 1111 1111 1111, +1 (555) 123-4567", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns with the names of results.
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.withColumns({"size": F.lit("x"), "fp": F.lit(1.5), "lang": F.lit(None).cast("string")})


def test_bpe(docs):
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text, _ in ROWS:
        ids = tool.encode(text or "", add_special_tokens=False).ids
        back = tool.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids))
    got = [tuple(r) for r in bpe.encode_documents(docs, with_ids=True).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_chunk_joins():
    tool = bpe.codec()
    for text in [r[1] for r in ROWS if r[1]]:
        data = text.encode()
        parts = [(a, b, tool.encode(data[a:b].decode())) for a, b in bpe.chunks(data, bits=4)]
        assert bpe.assemble(data, parts, tool) == tool.full.encode(text, add_special_tokens=False).ids


def test_quality(docs):
    got = {r["doc_id"]: r["q"] for r in quality.with_quality(docs, ["doc_id"]).select("row.doc_id", "q").collect()}
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
    assert got[4]["base_failed"] and got[4]["n_repeat_words"] == 4000
    assert got[7]["kept"] and got[7]["n_repeat_words"] == 0 and got[7]["n_words"] == 800
    assert quality.judge("a b c a b c d")[4] == 6
    assert quality.clean_documents(docs).columns == docs.columns
    assert {r.doc_id for r in quality.clean_documents(docs).collect()} == {7, 8}
    lines = PASSAGE + "\nHome | News | Shop\nAll rights reserved.\n" + PASSAGE[:200] + "\n" + PASSAGE[:200]
    assert quality.judge(lines)[8] == PASSAGE + "\n" + PASSAGE[:200]


@pytest.mark.parametrize(
    "line",
    ["Home", "About us", "Home | About", "Sign in", "Home > News > Shop", "..........", "-----", "- - - -", "$$ ## win",
     "All rights reserved.", "(c) 2020 Some Firm. All rights reserved.", "Released under the MIT License.", "Please enable JavaScript."],
)
def test_failing_lines(line):
    assert quality.line_fails(line, line.split())


@pytest.mark.parametrize(
    "line",
    ["the design in detail", "a catalog in the main hall", "his dialog in the play", "You can sign in at the desk before noon.",
     "They went home", "}", "--", "News of the day reached the shop", "é home", "unlicensed underwater work",
     "The film, which was shot on a small island over two long summers, was released under another title abroad."],
)
def test_lines_that_stay(line):
    assert not quality.line_fails(line, line.split())


def test_simhash(spark, docs):
    rows = simhash.with_fingerprint(docs, ["doc_id"]).select("row.doc_id", "fp")
    path = simhash.write_shared(rows, "t")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.with_component(path).collect()}

    def print_of(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [(d, print_of(t)) for d, t, _ in ROWS]
    assert {(d, f & (2**64 - 1)) for d, f in got} == set(prints)
    assert got[(5, dict(prints)[5] - (dict(prints)[5] >> 63 << 64))] == 4
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 9").count() == 1 and kept.filter("doc_id = 5").count() == 0


@pytest.mark.parametrize("block", [4, 2048])
def test_links_are_complete(spark, block):
    rng = np.random.default_rng(7)
    base = rng.integers(-(2**63), 2**63, 20, dtype=np.int64)
    values = set(base.tolist())
    for b in base.tolist():
        for _ in range(12):
            flips = sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 5), replace=False))
            x = (b ^ flips) & (2**64 - 1)
            values.add(x - (1 << 64) if x >> 63 else x)
    values = sorted(values)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), block)
    got = {r.node: r.root for r in components(links).collect()}
    assert {v: got.get(v, v) for v in values} == {v: find(v) for v in values}


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (900, 901), (901, 900)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 8), (None, [1.0] * 8), (1150, [0.5]), (1200, []), (301, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = topk.usable(df)
    vectors = {r.vec_id: r.v for r in good.collect()}
    assert set(vectors) == set(range(300)) | {1150, 1200, 301}
    queries = good.filter("vec_id % 50 = 0")
    got = sorted(map(tuple, topk.top_k(queries, good).collect()))
    want = []
    for q in (v for v in vectors if v % 50 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert got == sorted(want)
    assert topk.top_k(queries.limit(0), good.limit(0)).count() == 0


def test_pii(docs):
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert (got[9].n_email, got[9].n_ip, got[9].n_card, got[9].n_phone) == (1, 1, 1, 1)
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    text = "a@b@c.d x@y z.@1.2.3_q@r.s " + "1" * 50 + " 1.2.3.4.5.6.7.8 999.1.1.1 4111-1111-1111-1112"
    want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    assert pii.base_spans(text) == want


def test_pii_learns_contexts(spark):
    rows = [(i, f"please write to member u{i}@mail.org today") for i in range(30)]
    rows += [(100, "please write to member KX-48213 today"), (101, "the year 20481 was long and 48213abc too")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "id:23:31" and got[101] == ""


@pytest.mark.parametrize("seeds, unseen", [(30, 8), (100, 26), (30, 200)])
def test_pii_finds_more_with_more_text(spark, seeds, unseen):
    rows = [(i, f"please write to member u{i}@mail.org today") for i in range(seeds)]
    rows += [(1000 + i, f"please write to member KX-{48213 + i} today") for i in range(unseen)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[1000 + i].spans == "id:23:31" and got[1000 + i].n_found == 1 for i in range(unseen))


def test_pii_discoveries_support_patterns(spark):
    rows = [(i, f"please write to member u{i}@mail.org today") for i in range(30)]
    rows += [(100 + i, f"please write to member KX-{48213 + i} today") for i in range(6)]
    rows += [(200 + i, f"the badge with serial KX-{48213 + i} was lost") for i in range(6)]
    rows += [(300, "the badge with serial QQ-90125 was lost"), (301, "please write to member 12 345 678 today")]
    rows += [(400 + i, f"in all the summer of {20000 + i}x it rained") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert got[300] == "id:22:30" and got[301] == "id:23:33" and got[203] == "id:22:30"
    assert all(got[400 + i] == "" for i in range(40))
    accepted, _ = plain_bootstrap([(d, t) for d, t in rows])
    assert {d for d, s in got.items() if "id:" in s} == accepted
    assert pii.find(df.limit(0)).count() == 0


def plain_bootstrap(rows):
    """Ids of the rows that hold an accepted instance in a trusted pattern, by plain sets."""
    edges, seeds, at = set(), set(), []
    for doc_id, text in rows:
        for seed, value, _, _, patterns in pii.occurrences(text, pii.base_spans(text)):
            edges |= {(p, value) for p in patterns}
            seeds |= {value} if seed else set()
            at += [(doc_id, p, value) for p in patterns if not seed]
    accepted, trusted = set(), {}
    while True:
        values = {p: {v for q, v in edges if q == p} for p, _ in edges}
        supported = {p for p in values if len(values[p] & (seeds | accepted)) >= pii.SUPPORT}
        failed = set()
        for v in {v for _, v in edges} - seeds - accepted:
            own = {p for p, w in edges if w == v}
            if 2 * len(own & supported) < len(own):
                failed.add(v)
        trusted = {}
        for p in supported:
            good, bad = len(values[p] & (seeds | accepted)), len(values[p] & failed)
            if good / (good + bad + 1) >= pii.TRUSTED:
                trusted[p] = good / (good + bad + 1)
        new = set()
        for v in {v for _, v in edges} - seeds:
            doubt = np.prod([1 - t for p, t in trusted.items() if v in values[p]])
            if 1 - doubt >= pii.ACCEPTED:
                new.add(v)
        if new == accepted:
            return {d for d, p, v in at if p in trusted and v in accepted}, trusted
        accepted = new


def test_urls(spark):
    urls = [f"http://good{i}.example.net/en/{i}" for i in range(40)] + [f"http://spam{i}.net/x/{i}" for i in range(40)]
    urls += ["HTTP://GOOD3.Example.ORG/fr/1?x#y", "no address", None, "x://example.com/de/", "https://a.example.com/en/3", "http://a.net?q=/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlmodel.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()}
    assert got[0] == ("good0.example.net", "/en/0", "example.net/en/", "allow") and got[40][2:] == ("net/", "block")
    assert got[80] == ("good3.example.org", "/fr/1", "org/fr/", "allow") and got[81][:3] == ("", "", None) and got[82][:3] == ("", "", None)
    assert got[83][2:] == ("example.com/de/", "block") and got[84][2] is None and got[85][:3] == ("a.net", "", None)
    assert all(v[3] in ("allow", "block") for v in got.values()) and len(got) == len(urls)


def test_sharding(spark, docs):
    rows = sharding.shard_documents(docs, shards=4, slots=64).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    for doc_id, text, _ in ROWS:
        data = (text or "").encode()
        assert (by_id[doc_id].size, by_id[doc_id].text_crc32) == (len(data) + 1, zlib.crc32(data))
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))


def test_rebalance_moves_little():
    sizes = {s: (100 + s % 7, 1) for s in range(400)}
    first = sharding.first_map(sizes, 8)
    grown = sharding.rebalance(first, sizes, 9)
    load = [sum(sizes[s][0] for s in grown if grown[s] == k) for k in range(9)]
    assert max(load) - min(load) <= 0.03 * sum(load) / 9
    moved = [s for s in sizes if grown[s] != first[s]]
    assert sum(grown[s] == 8 for s in sizes) >= 40 and len(moved) <= 60  # a ninth of 400 slots is needed
    assert sharding.rebalance(grown, sizes, 9) == grown


def test_sainte_lague():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        votes, most = rng.integers(0, 50, n), rng.integers(0, 20, n)
        seats = int(rng.integers(0, 60))
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(most[i])))[:seats]
        want = np.bincount([i for _, i in quotients], minlength=n)
        got = mixing.sainte_lague(votes, seats, most)
        assert got.sum() == want.sum() and all(g == w or abs(g - w) == 1 for g, w in zip(got, want))
        ties = len({q for q, _ in quotients}) == len(quotients)
        assert not ties or (got == want).all()


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (50 + i % 37)), ["a", "b", None][i % 3]) for i in range(600)] + [(None, None, "z"), (601, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit(0))
    got = mixing.mix(df, block=8).collect()
    total, budget = sum(r.size for r in got), 0
    for name in ("a", "b", None, "z"):
        own = [r for r in got if r.source == name]
        taken, budget = sum(r.taken for r in own), budget + own[0].target
        assert abs(taken - own[0].target) <= 0.02 * own[0].target + 8 and all(0 <= r.taken <= 2 * r.size for r in own)
        assert own[0].source_size == sum(r.size for r in own)
    assert budget == pytest.approx(1.5 * total)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in mixing.mix(df).collect())
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_meets_the_target_of_a_small_source(spark):
    small = [(i, 20, "small") for i in range(300)]
    large = [(1000 + i, 400_000, "large") for i in range(50)]
    rows = spark.createDataFrame(small + large, "doc_id long, n int, source string")
    got = mixing.mix(rows.select("doc_id", "source", F.repeat(F.lit("w "), F.col("n")).alias("text")))
    for r in got.groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 0.02 * r.target, r


def test_missing_words_are_dealt_again():
    words = np.array([7, 90, 3, 500, 0, 64])
    for blocks in range(22):
        got = mixing.dealt_words(words, blocks, 64)
        assert (got <= 2 * words).all() and blocks * 64 - got.sum() < 64 or (got == 2 * words).all()


def test_language(spark):
    words = {"en": "the house and river of green trees", "de": "das haus und der fluss mit baum", "fr": "la maison et le fleuve avec arbre"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(words[g].split())), g) for i, g in enumerate(list(words) * 60)]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "der fluss und das haus", None), (None, "the trees", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in langid.predict(df, *langid.fit(df)).collect()}
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "de" and got[None].lang_pred == "en"
    assert all(got[i].lang_pred == g for i, _, g in rows[:180]) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert [r.lang_pred for r in langid.predict(df, *langid.fit(df.limit(0))).collect()] == ["und"] * len(rows)
