"""Exact removal of long repeats over all documents: a sparse suffix array around content-defined anchors.

Every string of ``length`` bytes contains an anchor: the least of its ``K``-byte hashes, the leftmost of
equals.  Equal strings have their anchor at the same place, so two of them meet in the group of that
anchor's hash.  Anchors number about two in ``length`` bytes; for each, the bytes around it that a string
through it can reach are its context.

1. Equal texts are taken once, with their number.
2. Anchors with equal contexts form a class, found by partial aggregates over 128-bit BLAKE2b digests of
   the contexts' own bytes.  A class of two or more repeats as a whole.
3. Where a group has a class of one anchor and another class, one context of each class is fetched, and
   the group's suffixes are sorted (multikey quicksort, then blind tries) to find the longest repeats
   through each anchor.
4. Ranges go back to the texts that have the anchors, are merged and removed.

A passage that a third of the documents share is one class at most of its anchors; only anchors near its
ends have many contexts, and a group of m contexts takes m log m steps.

Edge cases: null is empty; texts shorter than ``length`` are kept; repeated rows repeat each other, so
all of their strings go; overlapping occurrences in one text count; an empty table gives no rows;
ties (equal suffixes) are one class; a text of any length is hashed in pieces; removal is by bytes, so what
is kept is binary; columns other than id and text are not looked at.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunked
from .common import durable, load, partitions
from .jaccard import _mix

K = 32
#: Bytes of a text that are hashed at once.
PIECE = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, as many as have been asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64)]) for b in (_BASE, _INVERSE))
        return self.up, self.down


def _leftmost_least(a: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of each window of ``width``: prefix and suffix minima of blocks."""
    n = len(a)
    blocks = -(-n // width)
    x = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = a
    x = x.reshape(blocks, width)
    place = np.arange(blocks * width).reshape(blocks, width)
    low = np.minimum.accumulate(x, axis=1)
    fresh = np.ones(x.shape, bool)
    fresh[:, 1:] = x[:, 1:] < low[:, :-1]
    low_at = np.maximum.accumulate(np.where(fresh, place, 0), axis=1).ravel()
    high = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1]
    fresh = np.ones(x.shape, bool)
    fresh[:, :-1] = x[:, :-1] <= high[:, 1:]
    high_at = np.minimum.accumulate(np.where(fresh, place, n + width * 2)[:, ::-1], axis=1)[:, ::-1].ravel()
    low, high = low.ravel(), high.ravel()
    p = np.arange(n - width + 1)
    return np.where(high[p] <= low[p + width - 1], high_at[p], low_at[p + width - 1])


def anchors(data: bytes, length: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's anchors, and hashes of the K bytes there."""
    out = []
    n, reach = len(data), length - K
    for at in range(0, n - length + 1, PIECE):
        # the strings that start in the piece
        raw = np.frombuffer(data, np.uint8)[at : min(at + PIECE + length, n)]
        up, down = powers.get(len(raw) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)])
        last = min(at + PIECE, n - length + 1) - at
        kmers = _mix((total[K : last + reach + K] - total[: last + reach]) * down[: last + reach])
        place = np.unique(_leftmost_least(kmers, reach + 1))
        out.append((place + at, kmers[place]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, kmer = (np.concatenate(x) for x in zip(*out, strict=True))
    place, one = np.unique(place, return_index=True)
    return place, kmer[one]


def context_digests(data: bytes, place: np.ndarray, length: int) -> bytes:
    """16 bytes for each anchor, from the bytes around it and their number on the left."""
    whole, reach = memoryview(data), length - K
    return b"".join(hashlib.blake2b(whole[max(a - reach, 0) : a + length], digest_size=16, salt=min(a, reach).to_bytes(8, "little")).digest() for a in place.tolist())


def anchor_table(texts: DataFrame, length: int) -> DataFrame:
    """(key, copies, n, at, kmer, c1, c2) of each anchor of (key, copies, text); n is the text's length, c1 and c2 are its context's digest."""
    names = ["key", "copies", "n", "at", "kmer", "c1", "c2"]

    def run(batches):
        powers = Powers()
        for group in chunked(batches, 2):
            for b in group:
                sizes, places, kmers, digests = [], [], [], []
                for t in b.column(2).to_pylist():
                    data = t.encode()
                    place, kmer = anchors(data, length, powers)
                    places.append(place)
                    kmers.append(kmer)
                    digests.append(context_digests(data, place, length))
                    sizes.append((len(place), len(data)))
                take = np.repeat(np.arange(len(sizes)), [s for s, _ in sizes])
                n = np.array([s for _, s in sizes], np.int64)[take]
                digest = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take)), pa.array(n), pa.array(np.concatenate(places)), pa.array(np.concatenate(kmers).view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1])], names)

    return texts.select("key", "copies", "text").mapInArrow(run, "key binary, copies bigint, n bigint, at bigint, kmer bigint, c1 bigint, c2 bigint")


def context_matches(texts: DataFrame, wanted: DataFrame, length: int, buckets: int) -> DataFrame:
    """(c1, c2, ranges array<struct<l, r>>): repeats through the anchors of each class, from one context of each class of a group."""
    reach = length - K
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("at", "kmer", "c1", "c2")).alias("anchors"))

    def fetch(batches):
        for group in chunked(batches, 0):
            for b in group:
                for text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    data = text.encode()
                    at = [x["at"] for x in found]
                    yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in found], pa.int64()) for c in ("kmer", "c1", "c2")), pa.array([data[max(a - reach, 0) : a][::-1] for a in at], pa.binary()), pa.array([data[a : a + length] for a in at], pa.binary())], ["kmer", "c1", "c2", "before", "after"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .suffix_sort import matches

        table = pa.Table.from_batches(list(batches))
        kmer, c1, c2 = (table.column(c).to_numpy() for c in ("kmer", "c1", "c2"))
        before, after = table.column("before").combine_chunks(), table.column("after").combine_chunks()
        order = np.argsort(kmer, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], kmer[order][1:] != kmer[order][:-1], [True]]))
        x1, x2, ranges = [], [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            ids = order[a:b].tolist()
            if len(ids) < 2:
                continue
            found = matches([before[i].as_py() for i in ids], [after[i].as_py() for i in ids], length)
            for i, r in zip(ids, found, strict=True):
                if r:
                    x1.append(c1[i])
                    x2.append(c2[i])
                    ranges.append([{"l": x, "r": y} for x, y in r])
        yield pa.RecordBatch.from_arrays([pa.array(x1, pa.int64()), pa.array(x2, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("l", pa.int64()), ("r", pa.int64())])))], ["c1", "c2", "ranges"])

    contexts = texts.select("key", "text").join(lists, "key").select("text", "anchors").mapInArrow(fetch, "kmer bigint, c1 bigint, c2 bigint, before binary, after binary")
    dealt = contexts.withColumn("bucket", F.pmod(F.xxhash64("kmer"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(compare_only(compare), "c1 bigint, c2 bigint, ranges array<struct<l:bigint,r:bigint>>")


def compare_only(f):
    """``f`` with the annotations by which Spark knows that it takes and gives batches one by one."""
    f.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return f


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(id, n_bytes, spans array<struct<start, end>>, kept binary): maximal removed byte ranges and what is left."""
    spark = docs.sparkSession
    buckets = max(16, 2 * partitions(spark))
    keyed = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = durable(keyed.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")))
    found = durable(anchor_table(texts.where(F.octet_length("text") >= length), length))
    classes = durable(found.groupBy("kmer", "c1", "c2").agg(F.sum("copies").alias("times"), F.min(F.struct("key", "at")).alias("one")))
    groups = classes.groupBy("kmer").agg(F.count("*").alias("classes"), F.min("times").alias("least")).where("classes > 1 AND least = 1").select("kmer")
    wanted = durable(classes.join(groups, "kmer").select("kmer", "c1", "c2", "one.key", "one.at"))
    partial = context_matches(texts, wanted, length, buckets)
    whole = classes.where("times > 1").select("c1", "c2", F.array(F.struct(F.lit(length).cast("bigint").alias("l"), F.lit(length).cast("bigint").alias("r"))).alias("ranges"))
    known = whole.unionByName(partial).groupBy("c1", "c2").agg(F.max_by("ranges", F.element_at("ranges", 1)["l"]).alias("ranges"))
    hits = found.drop("kmer", "copies").join(durable(known), ["c1", "c2"])
    left, right = F.least("at", F.lit(length - K)), F.least(F.col("n") - F.col("at"), F.lit(length))
    spans = F.transform("ranges", lambda x: F.struct((F.col("at") - F.least(x.l, left)).alias("start"), (F.col("at") + F.least(x.r, right)).alias("end")))
    spans = F.filter(spans, lambda s: s.end - s.start >= length)
    lists = hits.select("key", spans.alias("spans")).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def cut(batches):
        for group in chunked(batches, 1):
            for b in group:
                n, spans, kept = [], [], []
                for text, found_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    data, merged = text.encode(), []
                    for s, e in sorted((x["start"], x["end"]) for x in found_ or []):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    at, parts = 0, []
                    for s, e in merged:
                        parts.append(data[at:s])
                        at = e
                    parts.append(data[at:])
                    n.append(len(data))
                    spans.append([{"start": s, "end": e} for s, e in merged])
                    kept.append(b"".join(parts))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["key", "n_bytes", "spans", "kept"])

    done = texts.select("key", "text").join(lists, "key", "left").select("key", "text", "spans").mapInArrow(cut, "key binary, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return keyed.select(F.col("id").alias(id_col), "key").join(done, "key")


def query(spark, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    done = remove_repeats(load(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
