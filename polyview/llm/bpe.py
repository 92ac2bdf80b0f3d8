"""Byte-level BPE through a global shuffle of distinct words.

1. Pre-tokens are exploded with their positions, a few megabytes of text (a chunk) at a time: the
   chunk's distinct words, dealt into buckets by a hash of the word, and for each position the number
   of its word.  This table is written to the shared folder.
2. The word lists of all chunks meet by bucket; each distinct word is encoded once, and its ids go
   back to every chunk that has it.
3. Each chunk joins the ids to its positions and reassembles its documents; ids are decoded by a join
   with the token-byte table, which is as large as the vocabulary file and no larger.

A frequent word is one entry per chunk, so no key is hot.  Word lists and id lists travel packed.

Edge cases: a null or empty text has no ids; a text larger than a chunk is a chunk of its own; a word
may be as long as its text; repeated rows stay; an empty table gives no rows; special tokens' strings
are ordinary text; columns other than id and text are not looked at.
"""

import base64
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, load, partitions

CHUNK = 16 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: one base64 token and its id a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


_ENCODERS: dict = {}


def _encoder(ranks: dict[bytes, int], name: str):
    import tiktoken

    if name not in _ENCODERS:
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def pack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, one byte plane after another: small numbers cost little."""
    return pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpack(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_longs(x: np.ndarray) -> bytes:
    """As ``pack_numbers``, 64-bit."""
    return pack(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_longs(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpack(data), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    """Front coding: how much each word shares with the one before (255 bytes at most), how long the rest is, and the rests."""
    shared, rests, last = [], [], b""
    for w in words:
        k, most = 0, min(len(w), len(last), 255)
        while k < most and w[k] == last[k]:
            k += 1
        shared.append(k)
        rests.append(w[k:])
        last = w
    head = pack_numbers(np.array([*shared, *map(len, rests)], np.uint32))
    return len(head).to_bytes(4, "little") + head + pack(b"".join(rests))


def unpack_words(data: bytes) -> list[bytes]:
    cut = 4 + int.from_bytes(data[:4], "little")
    shared, sizes = unpack_numbers(data[4:cut]).reshape(2, -1).tolist()
    rests, at, out, last = unpack(data[cut:]), 0, [], b""
    for k, n in zip(shared, sizes, strict=True):
        last = last[:k] + rests[at : at + n]
        at += n
        out.append(last)
    return out


def chunked(batches, text_at: int = 1, limit: int = CHUNK):
    """Lists of record-batch slices that hold about ``limit`` bytes of text together, never less than a row."""
    held, total = [], 0
    for b in batches:
        sizes = pyarrow.compute.fill_null(pyarrow.compute.binary_length(b.column(text_at)), 0).to_pylist()
        at = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                if i > at:
                    held.append(b.slice(at, i - at))
                yield held
                held, total, at = [], 0, i
            total += n
        if at < len(sizes):
            held.append(b.slice(at))
    if held:
        yield held


def lay_out(words: list[bytes], local: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None], np.ndarray]:
    """Number a chunk's words anew.

    place: the number of each word; order: the words as the buckets list them; lists: packed words of
    each bucket, None for none; classes: how many words each (bucket, class) has.  See explode_pretokens.
    """
    n = len(words)
    was = np.array(sorted(range(n), key=words.__getitem__), np.int64)
    bucket = np.fromiter((zlib.crc32(words[i]) for i in was.tolist()), np.uint32, n) % buckets
    cls = np.frexp(np.bincount(local, minlength=n)[was])[1]
    place = np.empty(n, np.uint32)
    place[was[np.lexsort((bucket, -cls))]] = np.arange(n, dtype=np.uint32)
    by_bucket = np.lexsort((-cls, bucket))
    order = was[by_bucket]
    ends = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
    lists = [pack_words([words[i] for i in order[a:b].tolist()]) if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return place, order, lists, np.bincount(bucket * 32 + (31 - cls), minlength=buckets * 32)


def by_number(classes: bytes, buckets: int) -> np.ndarray:
    """Place in the buckets' lists, put end to end, of each word number."""
    return np.argsort(np.repeat(np.tile(np.arange(32), buckets), unpack_numbers(classes)), kind="stable")


def explode_pretokens(docs: DataFrame, pattern: str, id_col: str, text_col: str, buckets: int, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row per chunk: chunk, ids, lengths (pre-tokens per document), stream (packed word numbers), classes, words (packed, one entry per bucket).

    A word's class is the number of bits of its count in the chunk.  Words are numbered by falling
    class, bucket and bytes; a bucket lists its words by falling class and bytes, and ``classes``
    (buckets * 32 counts) ties the two orders together.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches):
        import regex
        from pyspark import TaskContext

        find, part, k = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        for group in chunked(batches, limit=chunk_bytes):
            number: defaultdict[str, int] = defaultdict()
            number.default_factory = number.__len__
            lengths, streams = [], []
            for b in group:
                for text in b.column(1).to_pylist():
                    found = find(text) if text else []
                    lengths.append(len(found))
                    streams.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
            local = np.concatenate(streams) if streams else np.empty(0, np.uint32)
            place, _, lists, classes = lay_out([w.encode() for w in number], local, buckets)
            ids = pa.concat_arrays([x for b in group for x in [b.column(0)]])
            arrays = [pa.array([part << 33 | k], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([lengths], pa.list_(pa.int32())), pa.array([pack_numbers(place[local])], pa.binary()), pa.array([pack_numbers(classes)], pa.binary()), pa.array([lists], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)
            k += 1

    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("stream", T.BinaryType()), T.StructField("classes", T.BinaryType()), T.StructField("words", T.ArrayType(T.BinaryType()))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def encode_words(lists: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(bucket, chunk, words) -> (bucket, chunk, tokens): ids of each listed word; every distinct word of a bucket is encoded once."""
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shared = lists.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = _encoder(shared.value, name), {}
        for b in batches:
            for bucket, chunk, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = unpack_words(packed)
                for w in words:
                    if w not in known:
                        known[w] = enc.encode_ordinary(w.decode())
                ids = [known[w] for w in words]
                flat = np.fromiter((i for x in ids for i in x), np.uint32)
                data = np.concatenate([np.array([len(ids), *map(len, ids)], np.uint32), flat])
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([pack_numbers(data)], pa.binary())], ["bucket", "chunk", "tokens"])

    return lists.groupBy("bucket").applyInArrow(run, "bucket int, chunk bigint, tokens binary")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """(id, tokens array<int>): the ids of each document."""
    return _assemble(docs, ranks, pattern, id_col, text_col, chunk_bytes, T.StructField("tokens", T.ArrayType(T.IntegerType())), lambda ids, _: [pa.array(ids, pa.list_(pa.int32()))])


def decode(tokens: DataFrame, ranks: dict[bytes, int], tokens_col: str = "tokens", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes of its ids: each batch is joined with the broadcast token-byte table. Unknown ids raise."""
    table = tokens.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield s.map(lambda ids: None if ids is None else b"".join(map(table.value.__getitem__, ids)))

    return tokens.withColumn(out_col, F.pandas_udf(run, T.BinaryType())(tokens_col))


def _assemble(docs, ranks, pattern, id_col, text_col, chunk_bytes, field, make):
    spark = docs.sparkSession
    buckets = max(16, partitions(spark))
    chunks = durable(explode_pretokens(docs, pattern, id_col, text_col, buckets, chunk_bytes), "uncompressed")
    lists = chunks.select(F.posexplode("words").alias("bucket", "words"), "chunk").where("words IS NOT NULL").select("bucket", "chunk", "words")
    back = encode_words(lists, ranks)
    id_type = docs.schema[id_col].dataType
    fields = field if isinstance(field, list) else [field]
    schema = T.StructType([T.StructField(id_col, id_type), *fields])
    table = spark.sparkContext.broadcast({i: t for t, i in ranks.items()})

    def run(left, right):
        ids = left.column("ids").combine_chunks()
        if not len(ids):
            return pa.table([pa.array([], type=f) for f in _arrow(schema)], names=schema.names)
        parts = [np.zeros(1, np.uint32), *(unpack_numbers(t) for _, t in sorted(zip(right.column("bucket").to_pylist(), right.column("tokens").to_pylist(), strict=True)))]
        sizes = np.concatenate([p[1 : 1 + p[0]] for p in parts]).astype(np.int64)
        flat = np.concatenate([p[1 + p[0] :] for p in parts])
        starts = np.cumsum(sizes) - sizes
        at = by_number(left.column("classes")[0].as_py(), buckets)
        sizes, starts = sizes[at], starts[at]
        stream = unpack_numbers(left.column("stream")[0].as_py())
        lengths = left.column("lengths")[0].as_py()

        def each():
            at = 0
            for n in lengths:
                w = stream[at : at + n]
                at += n
                k = sizes[w]
                ends = np.cumsum(k)
                yield flat[np.repeat(starts[w] - (ends - k), k) + np.arange(ends[-1] if n else 0)]

        return pa.table([ids.flatten(), *make(each(), table.value)], names=schema.names)

    return chunks.select("chunk", "ids", "lengths", "stream", "classes").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(run, schema)


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, decode, and digest both inside the chunk, so that ids need not leave it."""

    def make(ids, table):
        n, a, b = [], [], []
        for x in ids:
            n.append(len(x))
            a.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
            b.append(hashlib.sha256(b"".join(map(table.__getitem__, x.tolist()))).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _assemble(docs, ranks, pattern, id_col, text_col, chunk_bytes, fields, make)


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pre-token pattern of a public vocabulary file."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir, "documents"), *vocabulary())
