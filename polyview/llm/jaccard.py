"""N-gram Jaccard self-join with vertical partitioning.

A document is the set of its word n-grams, as 64-bit hashes.  Documents with equal sets form a class, and
only classes are joined.  All n-grams have one global order: those that a sketch calls frequent last, and
by hash within each half.  The sketch is made of counts over all documents.  Similar sets must share an n-gram among the first few of this order (the prefix),
so candidates come from posting lists of prefix n-grams.  The order decides only how long those lists are,
never which links are found, so the sketch may err.

Each class goes to its longest posting list, and to up to five more that are long.  These lists are cut
into blocks, and a task compares the sets of two blocks by counting, so no pair becomes a row unless it
links two components.  After that, a list makes pairs only of classes that are still in different
components and share none of the compared lists; these are verified too, so every pair that could link
two components is looked at.

Verification cuts the global order (the hash range) into fragments; each set becomes one row per
fragment, partial overlaps are counted fragment by fragment and summed per pair.

Edge cases: texts that are null, empty or white space have empty sets and link with nothing; fewer words
than n make one n-gram of the whole sequence; repeated rows are copies of each other; a null id never
names a component unless it is alone; an empty table gives no rows; further columns are not looked at.
Hashes of 64 bits may collide: of 10^9 classes, two would be taken as one with a chance of 3 %.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunked, pack_longs, pack_numbers, unpack_longs, unpack_numbers
from .common import WORD, durable, load, partitions, tokenise
from .components import components

#: Bits of the sketch of frequent n-grams, over all buckets; 2 MB whatever the input.
SKETCH_BITS = 1 << 24
#: So many sightings over all documents make an n-gram frequent.
SKETCH_LEAST = 48
#: Longer words (in bytes) are hashed one by one.
LONG_WORD = 256
#: Besides its longest list, a class is compared in up to LONG_RUNS - 1 more that have LONG members.
LONG, LONG_RUNS = 64, 6
CHUNK = 4 << 20
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """64-bit hashes of words, eight bytes of all words at a time."""
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(bytes(words.buffers()[2] or b"") + bytes(8), np.uint8)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from every place on
    start, size = ends[:-1], np.diff(ends)
    out = _mix(size.astype(np.uint64) * _MULT[0] + _MULT[1])
    at = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    for done in range(0, LONG_WORD, 8):
        at = at[size[at] > done]
        if not len(at):
            break
        unused = np.maximum(8 - (size[at] - done), 0).astype(np.uint64) * np.uint64(8)
        out[at] = _mix((out[at] ^ (eight[start[at] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> unused))) * _MULT[2] + _MULT[3])
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[ends[i] : ends[i + 1]], digest_size=8).digest(), "little")
    return out


def ngrams(texts: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every n-gram of the texts, as they come."""
    stream, lengths, distinct = tokenise(pa.array(texts, pa.string()))
    hashed = word_hashes(distinct)[stream] if len(stream) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(stream))  # words from here to the text's end
    grams = np.zeros(len(stream), np.uint64)
    for i in range(n):
        shifted = np.concatenate([hashed[i:], np.zeros(min(i, len(hashed)), np.uint64)])
        grams = _mix(grams * _MULT[i % 4] + np.where(left > i, shifted, np.uint64(i + 1)))
    first = np.arange(len(stream)) == np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = (left >= n) | (first & (left < n))
    return owner[keep], grams[keep]


def _by(groups: np.ndarray) -> np.ndarray:
    """A stable order by small numbers."""
    return np.argsort(groups.astype(np.uint16) if len(groups) and groups.max() < 1 << 16 else groups, kind="stable")


def ngram_sets(texts: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every distinct n-gram of the texts, sorted by owner and hash."""
    owner, grams = ngrams(texts, n)
    order = np.argsort(grams)
    order = order[_by(owner[order])]
    owner, grams = owner[order], grams[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    return owner[fresh], grams[fresh]


def _short(grams: np.ndarray) -> np.ndarray:
    """The upper 40 bits, by which n-grams are counted."""
    return grams >> np.uint64(24)


def _split(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram (a range of hashes), and its bit in the bucket's part of the sketch."""
    short = _short(grams)
    return ((short * np.uint64(buckets)) >> np.uint64(40)).astype(np.int64), (short % np.uint64(SKETCH_BITS // buckets)).astype(np.int64)


def _pack64(x: np.ndarray) -> bytes:
    return x.astype("<u8").tobytes()


def frequent_sketch(docs: DataFrame, text_col: str, n: int, buckets: int) -> np.ndarray:
    """Bitmap (buckets, bits) of the n-grams seen at least SKETCH_LEAST times in all documents."""

    def count(batches):
        for group in chunked(batches, 0, CHUNK):
            grams = np.sort(ngrams([t for b in group for t in b.column(0).to_pylist()], n)[1])
            cuts = np.searchsorted(_split(grams, buckets)[0], np.arange(buckets + 1)).tolist()
            rows = []
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:  # sorted hashes as differences
                    keys, times = np.unique(_short(grams[a:b]), return_counts=True)
                    rows.append((i, pack_longs(np.diff(keys, prepend=np.uint64(0))), pack_numbers(times)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], ["bucket", "grams", "times"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, times, bucket = [], [], None
        for b in batches:
            for bucket, g, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                grams.append(np.cumsum(unpack_longs(g)))
                times.append(unpack_numbers(t))
        grams, times = np.concatenate(grams), np.concatenate(times)
        order = np.argsort(grams)
        grams, times = grams[order], times[order].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        often = grams[start[np.add.reduceat(times, start) >= SKETCH_LEAST]].astype(np.uint64)
        bits = np.zeros(SKETCH_BITS // buckets, bool)
        bits[_split(often << np.uint64(24), buckets)[1]] = True
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bucket", "bits"])

    found = docs.select(text_col).mapInArrow(count, "bucket int, grams binary, times binary").groupBy("bucket").applyInArrow(merge, "bucket int, bits binary")
    out = np.zeros((buckets, SKETCH_BITS // buckets), bool)
    for r in found.toLocalIterator():
        out[r.bucket] = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), count=out.shape[1]).astype(bool)
    return out


def prefixes(docs: DataFrame, sketch: np.ndarray, text_col: str, n: int, percent: int, buckets: int) -> DataFrame:
    """One row per document: id, text_key, cid (class), size (of the set), prefix (hashes; null for all but one document of a class in a chunk)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(sketch))
    shape = sketch.shape
    id_type = docs.schema["id"].dataType
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", id_type), T.StructField("text_key", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("prefix", T.BinaryType())])

    def run(batches):
        bits = np.unpackbits(shared.value, count=shape[0] * shape[1]).astype(bool).reshape(shape)
        for group in chunked(batches, 1, CHUNK):
            texts = [t for b in group for t in b.column(1).to_pylist()]
            owner, grams = ngram_sets(texts, n)
            size = np.bincount(owner, minlength=len(texts))
            ends = np.cumsum(size)
            cid = np.array([int.from_bytes(hashlib.blake2b(grams[e - s : e].tobytes(), digest_size=8).digest(), "little", signed=True) for s, e in zip(size.tolist(), ends.tolist(), strict=True)], np.int64)
            _, one = np.unique(cid, return_index=True)
            rep = np.zeros(len(texts), bool)
            rep[one] = True
            keep = rep[owner]
            owner, grams = owner[keep], grams[keep]
            bucket, bit = _split(grams, buckets)
            order = _by(2 * owner + bits[bucket, bit])  # n-grams are in order already
            owner, grams, bucket = owner[order], grams[order], bucket[order]
            per = np.bincount(owner, minlength=len(texts))
            place = np.arange(len(owner)) - (np.cumsum(per) - per)[owner]
            keep = place < size[owner] + (-percent * size[owner] // 100) + 1
            owner, grams = owner[keep], grams[keep]
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
            prefix = [_pack64(grams[a:b]) if one else None for a, b, one in zip(cuts[:-1], cuts[1:], rep.tolist(), strict=True)]
            columns = [pa.concat_arrays([b.column(i) for b in group]) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cid), pa.array(size, pa.int32()), pa.array(prefix, pa.binary())], schema.names)

    return docs.select("id", text_col, F.xxhash64(text_col).alias("text_key")).mapInArrow(run, schema)


def posting_lists(found: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(gram, run, m, cid, size): members of posting lists; m counts a run's members.

    Members are ordered by size, and a run ends where the next size is too far for a link; runs of one
    class are left out.  Of runs with the same members one is kept.
    """

    def deal(batches):
        for batch in batches:
            rows = [x for x in zip(*(c.to_pylist() for c in batch.columns), strict=True) if x[2]]
            grams = np.frombuffer(b"".join(x[2] for x in rows), "<u8")
            per = np.array([len(x[2]) // 8 for x in rows], np.int64)
            cids, sizes = np.repeat(np.array([x[0] for x in rows], np.int64), per), np.repeat(np.array([x[1] for x in rows], np.int64), per)
            bucket, _ = _split(grams, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = [(i, order[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), *(pa.array([f(x[at]) for _, at in some], pa.binary()) for f, x in ((_pack64, grams), (lambda y: y.astype("<i8").tobytes(), cids), (pack_numbers, sizes)))], ["bucket", "grams", "cids", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, c, s = [], [], []
        for b in batches:
            for _, grams, cids, sizes in zip(*(x.to_pylist() for x in b.columns), strict=True):
                g.append(np.frombuffer(grams, "<u8"))
                c.append(np.frombuffer(cids, "<i8"))
                s.append(unpack_numbers(sizes).astype(np.int64))
        g, c, s = np.concatenate(g), np.concatenate(c), np.concatenate(s)
        order = np.lexsort((c, s, g))
        g, c, s = g[order], c[order], s[order]
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        g, c, s = g[fresh], c[fresh], s[fresh]
        start = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (s[:-1] * 100 < s[1:] * percent)]))
        count = np.diff(np.append(start, len(g)))
        # an order-free digest of a run's members; equal digests (and lengths) are equal runs
        digest = np.add.reduceat(_mix(c.view(np.uint64)), start) ^ _mix(np.bitwise_xor.reduceat(_mix(c.view(np.uint64) + np.uint64(1)), start))
        _, one = np.unique(np.stack([digest, count.astype(np.uint64)]), axis=1, return_index=True)
        pick = np.zeros(len(start), bool)
        pick[one] = True
        keep = np.repeat((count > 1) & pick, count)
        head, many = np.repeat(start, count)[keep], np.repeat(count, count)[keep]
        at = np.flatnonzero(keep)
        for low in range(0, len(at), 1 << 18):
            z = slice(low, low + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(g[at[z]].view(np.int64)), pa.array(head[z].astype(np.int64)), pa.array(many[z].astype(np.int64)), pa.array(c[at[z]]), pa.array(s[at[z]])], ["gram", "run", "m", "cid", "size"])

    dealt = found.where("prefix IS NOT NULL").select("cid", "size", "prefix").mapInArrow(deal, "bucket int, grams binary, cids binary, sizes binary")
    return dealt.groupBy("bucket").applyInArrow(run, ", ".join(f"{x} bigint" for x in ("gram", "run", "m", "cid", "size")))


def _near_size(a, b, percent: int):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def class_texts(docs: DataFrame, found: DataFrame, cids: DataFrame) -> DataFrame:
    """(cid, text): a text of each of the classes; texts that share a text_key are equal, so one of them is enough."""
    keys = found.select("cid", "text_key").join(cids.hint("merge"), "cid").groupBy("cid").agg(F.min("text_key").alias("text_key"))
    one = docs.select(F.xxhash64("text").alias("text_key"), "text").join(keys.hint("merge"), "text_key")
    return one.groupBy("text_key", "cid").agg(F.first("text").alias("text")).select("cid", "text")


def segments(texts: DataFrame, n: int, fragments: int, first: bool) -> DataFrame:
    """(cid, part, grams): the sets cut into fragments of the hash range; ``first``: fragment 0 only, else all others."""

    def cut(batches):
        for group in chunked(batches, 1, CHUNK):
            cids = np.concatenate([b.column(0).to_numpy() for b in group])
            owner, grams = ngram_sets([t for b in group for t in b.column(1).to_pylist()], n)
            part = (grams // np.uint64(-(-(1 << 64) // fragments))).astype(np.int64)
            keep = (part == 0) == first
            owner, grams, part = owner[keep], grams[keep], part[keep]
            edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])])) if len(owner) else np.zeros(0, np.int64)
            arrays = pa.ListArray.from_arrays(pa.array(np.append(edge, len(grams)).astype(np.int32)), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(cids[owner[edge]]), pa.array(part[edge].astype(np.int32)), arrays], ["cid", "part", "grams"])

    return texts.select("cid", "text").mapInArrow(cut, "cid bigint, part int, grams array<bigint>")


def _overlaps(pairs: DataFrame, seg: DataFrame) -> DataFrame:
    """(a, b, shared): n-grams that both of a pair have, summed over the fragments of ``seg``."""
    side = lambda c, x: seg.select(F.col("cid").alias(c), "part", F.col("grams").alias(x))
    both = pairs.select("a", "b").join(side("a", "x").hint("merge"), "a").join(side("b", "y").hint("merge"), ["b", "part"])
    return both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared")).groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int, fragments: int) -> DataFrame:
    """The pairs (a, b, size_a, size_b) whose sets are similar enough.

    The first fragment is counted for all pairs; most are out of reach after it: the n-grams missing
    there alone are more than a link may miss.  The others are counted for the rest, and summed.
    """
    least = F.ceil((F.col("size_a") + F.col("size_b")) * percent / (100 + percent))
    first = durable(segments(texts, n, fragments, True), "uncompressed")
    sizes = first.select("cid", F.size("grams").alias("in_first"))
    known = pairs.join(sizes.select(F.col("cid").alias("a"), F.col("in_first").alias("fa")), "a", "left").join(sizes.select(F.col("cid").alias("b"), F.col("in_first").alias("fb")), "b", "left")
    known = known.join(_overlaps(pairs, first), ["a", "b"], "left").fillna(0, ["fa", "fb", "shared"])
    # misses so far may not exceed size - least overlap, on either side
    open_ = known.where((F.col("fa") - F.col("shared") <= F.col("size_a") - least) & (F.col("fb") - F.col("shared") <= F.col("size_b") - least))
    open_ = durable(open_.select("a", "b", "size_a", "size_b", F.col("shared").alias("before")))
    needed = open_.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    others = _overlaps(open_, durable(segments(texts.join(needed.hint("merge"), "cid"), n, fragments, False), "uncompressed"))
    total = open_.join(others, ["a", "b"], "left").withColumn("shared", F.col("before") + F.coalesce("shared", F.lit(0)))
    return durable(total.where(F.col("shared") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("shared")) * percent).select("a", "b"))


def _ordered(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs with a < b and sizes near enough for a link."""
    turn = F.col("a") < F.col("b")
    near = pairs.where(F.col("a") != F.col("b")).where(_near_size(F.col("size_a"), F.col("size_b"), percent))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turn, F.col("size_a")).otherwise(F.col("size_b")).alias("size_a"), F.when(turn, F.col("size_b")).otherwise(F.col("size_a")).alias("size_b")).distinct()


def block_links(groups: DataFrame, texts: DataFrame, n: int, percent: int, fragments: int, block: int = 1024) -> DataFrame:
    """Links (a, b) that span the components within each group of (key, cid): every pair of a group is compared, no pair becomes a row.

    A group is cut into blocks of about ``block`` classes, and a task takes two blocks.  Overlaps are
    counted fragment by fragment of the n-gram order and summed.
    """
    counts = groups.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    placed = groups.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    dealt = placed.select("key", "cid", "own", F.explode(others).alias("x")).select("key", "cid", "own", "x.*").join(texts.hint("merge"), "cid").select("key", "i", "j", "own", "cid", "text")

    def compare(table: pa.Table) -> pa.Table:
        cid, own = table.column("cid").to_numpy(), table.column("own").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        owner, grams = ngram_sets(table.column("text").to_pylist(), n)
        size = np.bincount(owner, minlength=len(cid))
        shared = np.zeros((len(cid), len(cid)), np.float32)
        part = grams // np.uint64(-(-(1 << 64) // fragments))
        for f in range(fragments):
            here = part == np.uint64(f)
            _, gram, times = np.unique(grams[here], return_inverse=True, return_counts=True)
            who, often = owner[here], times[gram] > 1
            column = (np.cumsum(times > 1) - 1)[gram[often]]
            who = who[often]
            order = np.argsort(column, kind="stable")
            who, column = who[order], column[order]
            for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
                x, y = np.searchsorted(column, [low, low + 2048])
                has = np.zeros((len(cid), 2048), np.float32)
                has[who[x:y], column[x:y] - low] = 1
                shared += has @ has.T
        linked = shared.astype(np.int64) * 100 >= (size[:, None] + size[None, :] - shared.astype(np.int64)) * percent
        linked &= ((own[:, None] == i) & (own[None, :] == j)) | ((own[:, None] == j) & (own[None, :] == i))
        seen, a, b = np.zeros(len(cid), bool), [], []
        for root in range(len(cid)):
            queue = [] if seen[root] else [root]
            seen[root] = True
            while queue:
                at = queue.pop()
                new = np.flatnonzero(linked[at] & ~seen)
                seen[new] = True
                queue.extend(new.tolist())
                a.extend([cid[at]] * len(new))
                b.extend(cid[new])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = dealt.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint")
    return durable(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def join_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, fragments: int = 8) -> DataFrame:
    """(id, n_shingles, class_id, component_id, text_key, root): every document's set size and the least id among those it can reach by links; root is the same for documents that can reach each other."""
    spark = docs.sparkSession
    buckets = max(16, partitions(spark))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = durable(prefixes(docs, frequent_sketch(docs, "text", n, buckets), "text", n, percent, buckets), "uncompressed")
    lists = durable(posting_lists(found, percent, buckets))
    texts = durable(class_texts(docs, found, lists.select("cid").distinct()))
    # each class goes to its longest run, and to a few more long ones
    ranked = F.sort_array(F.collect_list(F.struct("m", "gram", "run")), asc=False)
    keys = lists.groupBy("cid", "size").agg(ranked.alias("runs"))
    keys = durable(keys.select("cid", "size", F.concat(F.slice("runs", 1, 1), F.filter(F.slice("runs", 2, LONG_RUNS - 1), lambda r: r.m >= LONG)).alias("keys")))
    links = block_links(keys.select(F.explode("keys").alias("key"), "cid"), texts, n, percent, fragments)
    roots = durable(components(links))
    # pairs across components that share a run but were not compared in one
    labelled = keys.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    members = durable(lists.select("gram", "run", "cid").join(labelled, "cid"))
    open_ = members.groupBy("gram", "run").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.col("keys")[0]).alias("k0"), F.max(F.col("keys")[0]).alias("k1")).where("lo != hi AND k0 != k1").select("gram", "run")
    rest = members.join(open_, ["gram", "run"])
    side = lambda x: rest.select("gram", "run", F.col("cid").alias(x), F.col("size").alias(f"size_{x}"), F.col("root").alias(f"root_{x}"), F.col("keys").alias(f"keys_{x}"))
    across = side("a").join(side("b"), ["gram", "run"]).where("root_a < root_b AND NOT arrays_overlap(keys_a, keys_b)")
    last = durable(_ordered(across, percent))
    if not last.isEmpty():
        needed = last.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        links = links.unionByName(verify(last, texts.join(needed.hint("merge"), "cid"), n, percent, fragments))
        roots = durable(components(links))
    rows = found.select("id", "text_key", "cid", F.col("size").cast("long").alias("n_shingles"))
    # documents with equal sets share a class, so a class without links is a component too; empty sets stand alone
    rooted = rows.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.where("n_shingles > 0").groupBy("root").agg(F.min("id").alias("least"))
    out = rooted.join(least, "root", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("cid").alias("class_id"), F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"), "text_key", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with one document of each group: the least id, null ids last, then the least text key. Documents with empty sets all stay."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name clashes with one in here
    id_, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    found = join_groups(plain, id_, text, **params).select(F.col(id_).alias("id"), F.col("text_key").alias("key"), "root", "n_shingles")
    rank = F.struct(F.col("id").isNull().alias("missing"), "id", "key")
    best = durable(found.where("n_shingles > 0").groupBy("root").agg(F.min(rank).alias("x")).select("x.id", "x.key"))
    keyed = plain.withColumn("key", F.xxhash64(text))
    has_words = F.regexp_like(F.coalesce(text, F.lit("")), F.lit(WORD))
    kept = keyed.where(has_words).alias("d").join(best.alias("b"), F.col(f"d.{id_}").eqNullSafe(F.col("b.id")) & (F.col("d.key") == F.col("b.key"))).select("d.*").dropDuplicates([id_, "key"])
    return kept.unionByName(keyed.where(~has_words)).drop("key").toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return join_groups(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
