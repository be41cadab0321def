"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

1. A rolling hash over 16 bytes cuts every text into chunks of about `CHUNK` bytes, at places that
   depend on nearby bytes only, so a passage shared by documents falls into the same chunks.
2. Chunks that two or more documents hold are encoded once; their token ids travel to the documents. A
   bitmap of fixed size over the shared chunks tells which texts have one; a false alarm costs work,
   never a result. Texts without a shared chunk are encoded where they are read.
3. Joins are repaired. A white-space character after a visible ASCII character starts a new piece of
   the tokenizer's splitting rule whatever stands around it, so encodings agree there. Around every
   join the text between the nearest such places on both sides, where they are also token bounds of
   the chunks' own encodings, is encoded again; a chunk without such a place joins that stretch.
   The result must decode to the text; else the whole text is encoded at once.

Texts within the first 592 code points are encoded by the vocabulary's rank form, all others, and
texts with the special token or very long runs, by the `tokenizers` form of the same vocabulary.

Defined cases: a null text counts as empty, with no tokens; equal rows get equal results; ids may be
null or repeat; an empty table gives an empty result; only `doc_id` and `text` are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import SLICE_BYTES, register, row_key, slices, table, write_shared

VOCABULARY = "byte_bpe_50k"
CHUNK_BITS = 10  # chunks of about 2**10 bytes
FILTER_BITS = 25  # 4 MB, whatever the size of the corpus
SPECIAL = "<|endoftext|>"
EDGE = re.compile(rb"(?<=[\x21-\x7e])[ \n]")
PLAIN = re.compile(r"[\x00-ɏ]*")
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")
MULTIPLIER = 0x01000193  # of the rolling hash, odd
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """One vocabulary in both forms."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        lines = open(public_tokenizers.path(f"{name}.tiktoken"), "rb").read().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.full.no_truncation()
        self.full.no_padding()
        self.bytes = [b""] * (len(ranks) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.bytes[self.full.token_to_id(SPECIAL)] = SPECIAL.encode()
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.names = [str(i) for i in range(len(self.bytes))]

    def encode(self, text: str) -> list[int]:
        if PLAIN.fullmatch(text) and SPECIAL not in text and not LONG_RUN.search(text):
            return self.plain.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> bytes:
        joined = b"".join(map(self.bytes.__getitem__, ids))
        return joined.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def codec(name: str = VOCABULARY) -> Codec:
    return Codec(name)


def chunks(data: bytes, bits: int = CHUNK_BITS) -> list[tuple[int, int]]:
    """(start, end) of the content-defined chunks, all on character bounds."""
    if not data:
        return []
    h = np.frombuffer(data, np.uint8).astype(np.uint32) * np.uint32(0x9E3779B1) ^ np.uint32(0x5BD1E995)
    for reach in (1, 2, 4, 8):  # h over 2, 4, 8, 16 bytes
        wider = h.copy()
        wider[reach:] += h[:-reach] * np.uint32(pow(MULTIPLIER, reach, 1 << 32))
        h = wider
    h ^= h >> np.uint32(15)
    cuts = np.flatnonzero((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits) == 0) + 1
    cuts = [c for c in cuts.tolist() if 16 <= c < len(data) and data[c] & 0xC0 != 0x80]
    return list(zip([0, *cuts], [*cuts, len(data)]))


def assemble(data: bytes, parts: list[tuple[int, int, list[int]]], tool: Codec) -> list[int]:
    """Ids of the whole text from separately encoded parts (start, end, ids) that cover it."""
    out, done = [], 0
    for start, end, ids in parts:
        first = 0 if start == 0 else next((m.start() for m in EDGE.finditer(data, start, end)), None)
        last = end if end == len(data) else last_edge(data, start, end)
        if first is None or last is None or last < first or first < done:
            continue
        bounds = np.concatenate(([0], np.cumsum(tool.sizes[ids]))) + start
        i, j = np.searchsorted(bounds, (first, last))
        if bounds[min(i, len(ids))] != first or bounds[min(j, len(ids))] != last:
            continue
        if done < first:
            out += tool.encode(data[done:first].decode())
        out += ids[i:j]
        done = last
    if done < len(data):
        out += tool.encode(data[done:].decode())
    return out


def last_edge(data: bytes, start: int, end: int) -> int | None:
    """The last edge after `start` and before `end`."""
    reach = 64
    while True:
        low = max(start + 1, end - reach)
        found = [m.start() for m in EDGE.finditer(data, low, end)]
        if found or low == start + 1:
            return found[-1] if found else None
        reach *= 4


def encode_with(data: bytes, known: dict[int, tuple[int, list[int]]], tool: Codec) -> list[int]:
    """Ids of a text, given the ids of some of its chunks as start -> (end, ids)."""
    if not known:
        return tool.encode(data.decode())
    parts, at = [], 0
    for start in [*sorted(known), len(data)]:
        if at < start:
            parts.append((at, start, tool.encode(data[at:start].decode())))
        if start < len(data):
            end, ids = known[start]
            parts.append((start, end, ids))
            at = end
    ids = assemble(data, parts, tool)
    if tool.decode(ids) != data:
        ids = tool.full.encode(data.decode(), add_special_tokens=False).ids
    return ids


def summary(ids: np.ndarray, tool: Codec) -> tuple[int, str, str]:
    ids = ids.tolist()
    listed = ",".join(map(tool.names.__getitem__, ids)).encode()
    return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(tool.decode(ids)).hexdigest()


def find_chunks(docs: DataFrame) -> DataFrame:
    """(key, start, size, chunk): all chunks of all texts, by the 128-bit hash of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, key = (text or "").encode(), row_key(doc_id, text)
                rows += [(key, s, e - s, xxhash.xxh3_128_digest(data[s:e])) for s, e in chunks(data)]
            columns = zip(*rows) if rows else ((), (), (), ())
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "start", "size", "chunk"])

    return docs.mapInArrow(run, "key binary, start int, size int, chunk binary")


def places(digest: bytes) -> np.ndarray:
    return np.frombuffer(digest, np.uint32) >> np.uint32(32 - FILTER_BITS)


def shared_filter(shared: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits over the shared chunks: words of it are or-ed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = places(b"".join(batch.column(0).to_pylist())).astype(np.int64)
            bits = np.left_shift(np.int64(1), place & 63)
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(bits)], names=["word", "bits"])

    words = shared.select("chunk").mapInArrow(run, "word long, bits long")
    found = words.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()  # at most 2**(FILTER_BITS - 6) rows
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bitmap


def listed(bitmap: np.ndarray, digest: bytes) -> bool:
    place = places(digest).astype(np.int64)
    return bool(((bitmap[place >> 6] >> (place & 63)) & 1).all())


def encode_shared(docs: DataFrame, shared: DataFrame, bitmap, name: str) -> DataFrame:
    """(chunk, ids): the token ids of every shared chunk, two bytes a token, each encoded once."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            found: dict[bytes, bytes] = {}
            for text in batch.column(0).to_pylist():
                data = (text or "").encode()
                for s, e in chunks(data):
                    digest = xxhash.xxh3_128_digest(data[s:e])
                    if digest not in found and listed(bitmap.value, digest):
                        found[digest] = data[s:e]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["chunk", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(name)
        for batch in (part for whole in batches for part in slices(whole, "data")):
            ids = [np.array(tool.encode(d.decode()), np.uint16).tobytes() for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(ids, pa.binary())], names=["chunk", "ids"])

    held = docs.select("text").mapInArrow(texts, "chunk binary, data binary")
    once = held.join(shared.select("chunk"), "chunk", "left_semi").groupBy("chunk").agg(F.first("data").alias("data"))
    return once.mapInArrow(run, "chunk binary, ids binary")


def batch_of(rows: list[tuple], with_ids: bool, more: list[pa.Array] = [], names: tuple[str, ...] = ()) -> pa.RecordBatch:
    """Rows (doc_id, ids or None) as RESULT, with `ids` itself on request, and further columns."""
    tool = codec()
    found = [(None, None, None) if ids is None else summary(ids, tool) for _, ids in rows]
    n, digests, decoded = zip(*found) if found else ((), (), ())
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array(n, pa.int64())]
    columns += [pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
    if with_ids:
        packed = [None if ids is None else np.array(ids, np.int32) for _, ids in rows]
        columns.append(pa.array(packed, pa.list_(pa.int32())))
    fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *names]
    return pa.RecordBatch.from_arrays(columns + more, names=fields)


def encode_documents(docs: DataFrame, name: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """RESULT for every row of `docs` (doc_id, text), and the token ids themselves on request."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = write_shared(find_chunks(docs), "chunks")
    # Shared means by different documents: a document that stands in several rows is one.
    owner = F.xxhash64("key")
    owners = found.groupBy("chunk").agg(F.min(owner).alias("low"), F.max(owner).alias("high"))
    shared = write_shared(owners.filter("low <> high").select("chunk"), "shared")
    bitmap = docs.sparkSession.sparkContext.broadcast(shared_filter(shared))
    coded = write_shared(encode_shared(docs, shared, bitmap, name), "coded")
    pieces = found.join(coded, "chunk").groupBy("key").agg(F.collect_list(F.struct("start", "size", "ids")).alias("pieces"))
    shape = RESULT + ", ids array<int>" * with_ids

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, pack = codec(name), zstandard.ZstdCompressor(level=3)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows, keys, packed = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode()
                waits = any(listed(bitmap.value, xxhash.xxh3_128_digest(data[s:e])) for s, e in chunks(data))
                keys.append(row_key(doc_id, text))
                packed.append(pack.compress(data) if waits else None)
                rows.append((doc_id, None if waits else np.array(tool.encode(text or ""), np.int32)))
            more = [pa.array(keys, pa.binary()), pa.array(packed, pa.binary())]
            yield batch_of(rows, with_ids, more, ("key", "packed"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, unpack = codec(name), zstandard.ZstdDecompressor()
        for batch in (part for whole in batches for part in slices(whole, "packed", SLICE_BYTES // 4)):
            ready = pa.Table.from_batches([batch]).select([f for f in batch.schema.names if f not in ("packed", "pieces")])
            waits = batch.column("packed").is_valid()
            yield from ready.filter(pa.compute.invert(waits)).to_batches()
            rows, held = [], 0
            for row in batch.select(["doc_id", "packed", "pieces"]).filter(waits).to_pylist():
                known = {
                    p["start"]: (p["start"] + p["size"], np.frombuffer(p["ids"], np.uint16).tolist())
                    for p in row["pieces"] or ()
                }
                rows.append((row["doc_id"], np.array(encode_with(unpack.decompress(row["packed"]), known, tool), np.int32)))
                held += rows[-1][1].nbytes
                if held > SLICE_BYTES:
                    yield batch_of(rows, with_ids)
                    rows, held = [], 0
            yield batch_of(rows, with_ids)

    read = docs.mapInArrow(first, f"{shape}, key binary, packed binary")
    return read.join(pieces, "key", "left").drop("key").mapInArrow(second, shape)


@register("op1_bpe")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"))
