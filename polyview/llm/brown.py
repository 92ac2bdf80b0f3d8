"""Brown class-based bigram language model: exchange clustering, class transitions, word emissions.

The text is cut into chunks of a few megabytes; each chunk keeps its distinct words, dealt into buckets
by hash, and a stream of word numbers.  What a chunk knows of a bucket's words travels as one packed row,
so the commonest word is no hotter than any other.

1. Each bucket numbers its words and counts them over all training text.
2. To start with, the exchange algorithm runs on the ``core`` commonest words, whose bigram table fits
   the driver; all other words stand in it as one more context class.  Every other word then goes to the
   class that its neighbours in the core make most likely.
3. Exchange sweeps over all words, the core too: each word is taken out and put into the class that makes
   the training text most likely, all words' current classes being its contexts.  The words of a sweep,
   one in PARTS by turns, move at once against the class bigrams before it; a sweep that lowers the
   likelihood is taken back, and half as many words move from then on.  Sweeps end when ``PARTS`` of them,
   so that every word had its turn, add less than ``tolerance`` to the mean log-likelihood (nats) of a
   token, or after ``passes``.
4. The class bigrams of the last sweep are the transitions.
5. Scores.  p(w | v) = mix * p(class w | class v) * p(w | class w) + (1 - mix) * unigram.  Emissions are
   add-one with one unknown word per class; transitions are smoothed with the class unigram; an unknown
   word is a context of its own with the class unigram as its row.  Each p(. | v) sums to one over the
   training words and one unknown word.

Edge cases: a null or empty text is one end token; a text longer than a chunk is a chunk of its own;
repeated rows count as often as they stand; a null id counts as an empty one; without training text all
words are unknown; classes that gain equally: the first, and a word stays where it is as good; an empty
table gives no rows; columns other than id and text are not looked at.
"""

import logging
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import by_number, chunked, lay_out, pack, pack_longs, pack_numbers, unpack, unpack_longs, unpack_numbers, unpack_words
from .common import crc_mod, durable, load, partitions, tokenise

log = logging.getLogger(__name__)

#: The end token; no word is empty.
END = b""
#: Bytes of text in a chunk; bounds the memory of a task.
CHUNK = 6 << 20
#: Words of a chunk whose contexts are counted at once, and words of a bucket that move at once.
BLOCK = 1 << 17
#: One word in so many moves in a sweep, to begin with.
PARTS = 2
#: Counts up to SMALL have their logarithms looked up.
SMALL = 16


def word_chunks(docs: DataFrame, id_col: str, text_col: str, held: Column, buckets: int, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row per chunk: chunk, ids, held, lengths (tokens per document), stream, classes (of ``lay_out``), words and counts (training counts) by bucket."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.ArrayType(T.IntegerType()))]
        + [T.StructField(c, T.BinaryType()) for c in ("stream", "classes")]
        + [T.StructField(c, T.ArrayType(T.BinaryType())) for c in ("words", "counts")]
    )

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, group in enumerate(chunked(batches, limit=chunk_bytes)):
            ids, texts, test = (pa.concat_arrays([b.column(i) for b in group]) for i in range(3))
            found, lengths, distinct = tokenise(texts)
            words = [*(w.encode() for w in distinct.to_pylist()), END]
            local = np.insert(found, np.cumsum(lengths), len(words) - 1)
            lengths = lengths + 1
            place, order, lists, classes = lay_out(words, local, buckets)
            learn = np.bincount(local[~np.repeat(test.to_numpy(zero_copy_only=False).astype(bool), lengths)], minlength=len(words))[order]
            ends = np.cumsum([0, *np.add.reduce(classes.reshape(buckets, 32), axis=1)])
            counts = [pack_longs(learn[a:b]) if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)]
            values = [pa.array([part << 33 | k], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.ListArray.from_arrays([0, len(ids)], test), pa.array([lengths], pa.list_(pa.int32())), pa.array([pack_numbers(place[local])], pa.binary()), pa.array([pack_numbers(classes)], pa.binary()), pa.array([lists], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(values, schema.names)

    return docs.select(id_col, text_col, held.alias("__held")).mapInArrow(run, schema)


NUMBERED = "bucket int, chunk bigint, ids binary, counts binary, n_tokens bigint, n_words bigint, top array<struct<word:binary,n:bigint>>"


def number_words(chunks: DataFrame, core: int) -> DataFrame:
    """For each bucket and chunk with words there: their numbers in the bucket and training counts over all chunks; chunk -1 has the bucket's sums and ``core`` commonest words."""
    lists = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("bucket", "x")).where("x.words IS NOT NULL").select("bucket", "chunk", "x.words", "x.counts")

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        listed = [unpack_words(x) for x in table.column("words").to_pylist()]
        words = sorted(set().union(*listed))
        number = {w: i for i, w in enumerate(words)}
        ids = [np.fromiter(map(number.__getitem__, x), np.int64, len(x)) for x in listed]
        total = np.zeros(len(words), np.int64)
        for i, n in zip(ids, table.column("counts").to_pylist(), strict=True):
            total[i] += unpack_longs(n)
        top = np.lexsort((np.arange(len(words)), -total))[:core]
        m = len(ids)
        return pa.table(
            [
                pa.array([bucket] * (m + 1), pa.int32()), pa.array([*table.column("chunk").to_pylist(), -1], pa.int64()), pa.array([*map(pack_numbers, ids), None], pa.binary()), pa.array([*(pack_longs(total[i]) for i in ids), None], pa.binary()),
                pa.array([None] * m + [int(total.sum())], pa.int64()), pa.array([None] * m + [int((total > 0).sum())], pa.int64()), pa.array([None] * m + [[{"word": words[i], "n": int(total[i])} for i in top if total[i]]], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
            ],
            names=["bucket", "chunk", "ids", "counts", "n_tokens", "n_words", "top"],
        )

    return lists.groupBy("bucket").applyInArrow(run, NUMBERED)


def _xlogx(x):
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """Exchange clustering of words 0 .. n - 1, in order of falling count, from their bigram table.

    ``pairs`` is (n + 1, n + 1): the last row and column are all other words, a class of their own.
    Words move one at a time to the class that raises the class-bigram likelihood most.
    """
    n = len(pairs) - 1
    pairs = pairs.astype(np.float64)
    k = classes + 1
    at = np.array([*(np.arange(n) % classes), classes])
    member = np.eye(k)[at]
    after, before = pairs @ member, pairs.T @ member
    table = member.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            g, own = at[w], pairs[w, w]
            p, q = after[w].copy(), before[w].copy()
            table[g] -= p
            table[:, g] -= q
            table[g, g] += own
            p[g] -= own
            q[g] -= own
            rows, cols = table.sum(axis=1) + q, table.sum(axis=0) + p  # the word is a neighbour of theirs in any class
            row = _xlogx(table + p) - _xlogx(table)
            col = _xlogx(table.T + q) - _xlogx(table.T)
            d = np.arange(k)
            here = table[d, d]
            gain = row.sum(axis=1) - row[d, d] + col.sum(axis=1) - col[d, d] + _xlogx(here + p + q + own) - _xlogx(here)
            gain -= _xlogx(rows + p.sum() + own) - _xlogx(rows) + _xlogx(cols + q.sum() + own) - _xlogx(cols)
            gain[classes] = -np.inf
            h = int(np.argmax(gain)) if gain.max() > gain[g] + 1e-9 else g
            table[h] += p
            table[:, h] += q
            table[h, h] += own
            if h != g:
                moved += 1
                at[w] = h
                for x, counts in ((after, pairs[:, w]), (before, pairs[w])):
                    x[:, g] -= counts
                    x[:, h] += counts
        if not moved:
            break
    return at[:n]


@dataclass
class Spec:
    """What scoring needs of the model; sizes depend on the number of classes only."""

    n: int
    v: int
    sums: np.ndarray  # (K, 2): tokens and words of each class
    moves: np.ndarray  # (K + 1, K): smoothed transition probabilities; the last row is for unknown words


def _training(b: dict) -> np.ndarray:
    """Word numbers of a chunk's training text."""
    return unpack_numbers(b["stream"])[np.repeat(~np.array(b["held"], bool), b["lengths"])].astype(np.int64)


def core_pairs(chunks: DataFrame, core: dict[bytes, int], buckets: int) -> DataFrame:
    """(a, b, n): bigram counts of core words in training text; len(core) stands for any other word."""
    shared = chunks.sparkSession.sparkContext.broadcast(core)
    m = len(core) + 1

    def run(batches):
        total = np.zeros(m * m, np.int64)
        for batch in batches:
            for b in batch.to_pylist():
                listed = np.array([shared.value.get(w, m - 1) for x in b["words"] if x for w in unpack_words(x)], np.int64)
                x = listed[by_number(b["classes"], buckets)][_training(b)]
                # the last token is an end token, and one stands before the first word
                total += np.bincount(np.concatenate([x[-1:], x[:-1]]) * m + x, minlength=m * m)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // m), pa.array(at % m), pa.array(total[at])], ["a", "b", "n"])

    found = chunks.select("held", "lengths", "stream", "classes", "words").mapInArrow(run, "a bigint, b bigint, n bigint")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


STATE = "bucket int, chunk bigint, cls binary"


def core_state(chunks: DataFrame, core: dict[bytes, int], cls: np.ndarray, other: int) -> DataFrame:
    """(bucket, chunk, cls): classes, a byte each, of the words a chunk has in a bucket; words outside the core are of class ``other``."""
    shared = chunks.sparkSession.sparkContext.broadcast({w: int(cls[i]) for w, i in core.items()})

    def run(batches):
        for batch in batches:
            for bucket, chunk, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = pack(bytes(shared.value.get(w, other) for w in unpack_words(words)))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], ["bucket", "chunk", "cls"])

    lists = chunks.select("chunk", F.posexplode("words").alias("bucket", "words")).where("words IS NOT NULL")
    return durable(lists.select("bucket", "chunk", "words").mapInArrow(run, STATE))


def _by_bucket(table: pa.Table, *columns: str) -> list[tuple]:
    return sorted(zip(*(table.column(c).to_pylist() for c in ("bucket", *columns)), strict=True), key=lambda x: x[0])


def contexts(body: DataFrame, state: DataFrame, k: int, buckets: int) -> DataFrame:
    """(bucket, chunk, cls, profile): for the words a chunk has in a bucket, how often each class stands after and before them and they after themselves; bucket -1 has the chunk's class bigrams as cls."""
    width = 2 * k + 1
    names = ["bucket", "chunk", "cls", "profile"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary())], names=names)
        chunk, *rest = (left.column(c)[0].as_py() for c in ("chunk", "held", "lengths", "stream", "classes"))
        own = _by_bucket(right, "cls")
        parts = [np.frombuffer(unpack(x), np.uint8) for _, x in own]
        ends = np.cumsum([0, *map(len, parts)])
        cls = np.concatenate(parts).astype(np.int64)
        b = by_number(rest[3], buckets)[_training(dict(zip(("held", "lengths", "stream"), rest[:3], strict=True)))]
        a = np.concatenate([b[-1:], b[:-1]])
        ca, cb = cls[a], cls[b]
        words, codes, counts = [], [], []
        for low in range(0, len(cls), BLOCK):
            size = min(BLOCK, len(cls) - low)
            x, y, same = (a, b, a == b) if size == len(cls) else ((a >= low) & (a < low + size), (b >= low) & (b < low + size), (a == b) & (a >= low) & (a < low + size))
            if size == len(cls):
                keys = np.concatenate([a * width + cb, b * width + k + ca, a[same] * width + 2 * k])
            else:
                keys = np.concatenate([(a[x] - low) * width + cb[x], (b[y] - low) * width + k + ca[y], (a[same] - low) * width + 2 * k])
            n = np.bincount(keys, minlength=size * width)
            at = np.flatnonzero(n)
            words.append(at // width + low)
            codes.append(at % width)
            counts.append(n[at])
        word, code, n = (np.concatenate(x) for x in (words, codes, counts))
        cuts = np.searchsorted(word, ends)
        rows = [pack_numbers(np.concatenate([np.bincount(word[i:j] - e, minlength=f - e), code[i:j], n[i:j]])) for i, j, e, f in zip(cuts[:-1], cuts[1:], ends[:-1], ends[1:], strict=True)]
        table = np.bincount(ca * k + cb, minlength=k * k).astype("<i8").tobytes()
        return pa.table([pa.array([*(x for x, _ in own), -1], pa.int32()), pa.array([chunk] * (len(own) + 1), pa.int64()), pa.array([*(x for _, x in own), table], pa.binary()), pa.array([*rows, b""], pa.binary())], names=names)

    return body.groupBy("chunk").cogroup(state.groupBy("chunk")).applyInArrow(run, f"{STATE}, profile binary")


class Gains:
    """What words add to the likelihood in each class, against one table of class bigrams."""

    def __init__(self, table: np.ndarray):
        t, n = table, np.arange(2 * SMALL + 1)[:, None, None]
        self.table, self.rows, self.cols = t, t.sum(axis=1), t.sum(axis=0)
        # a neighbour's class, then the word's
        self.next = _xlogx(t.T + n[: SMALL + 1]) - _xlogx(t.T)
        self.last = _xlogx(t + n[: SMALL + 1]) - _xlogx(t)
        n = n[:, :, 0]
        self.size = _xlogx(self.rows + n) - _xlogx(self.rows) + _xlogx(self.cols + n) - _xlogx(self.cols)
        self.diagonal = _xlogx(np.diag(t) + n) - _xlogx(np.diag(t))

    def exact(self, at: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """(words, classes): what each word, taken out of its class ``at``, adds in each class, as in ``exchange``."""
        table, (m, k) = self.table, after.shape
        each = np.arange(m)
        is_own = at[:, None] == np.arange(k)
        total, diagonal = np.zeros((m, k)), np.zeros((m, k))
        for side, raw, other, known in ((table, after, before, self.next), (table.T, before, after, self.last)):
            p = raw - is_own * own[:, None]
            w, d = np.nonzero(p)  # a class that is no neighbour adds nothing
            if len(w):
                n = p[w, d]
                gain = np.empty((len(w), k))
                small = n <= SMALL
                gain[small] = known[n[small].astype(np.intp), d[small]]
                # for a count far below those of the table, a series (error below n / 10 ** 6)
                near = ~small & (n * 50 <= side.min(axis=0)[d])
                log_t, inverse = np.log(np.maximum(side.T, 1)), 1 / np.maximum(side.T, 1)
                x, i = n[near][:, None], inverse[d[near]]
                gain[near] = x * (1 + log_t[d[near]] + x * i / 2 * (1 - x * i / 3))
                rest = ~small & ~near
                gain[rest] = _xlogx(side.T[d[rest]] + n[rest][:, None]) - _xlogx(side.T[d[rest]])
                # cells that hold the word itself: its class with d, and d with its class if d is that class
                home = side[at[w], d] - raw[w, d]
                same = np.flatnonzero(d == at[w])
                home[same] += own[w[same]] - other[w[same], at[w[same]]]
                cells = side.T[d[same]] - other[w[same]]
                gain[same] = _xlogx(cells + n[same][:, None]) - _xlogx(cells)
                gain[np.arange(len(w)), at[w]] = _xlogx(home + n) - _xlogx(home)
                gain[np.arange(len(w)), d] = 0
                first = np.flatnonzero(np.diff(w, prepend=-1))
                total[w[first]] += np.add.reduceat(gain, first)
            diagonal += p
            size = raw.sum(axis=1, keepdims=True)
            rest = side.sum(axis=1) - is_own * size
            total -= _xlogx(rest + size) - _xlogx(rest)
        here = np.tile(np.diag(table), (m, 1))
        here[each, at] -= after[each, at] + before[each, at] - own
        return total + _xlogx(here + diagonal + own[:, None]) - _xlogx(here)

    def rare(self, at: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """As ``exact``, for words of at most SMALL tokens, all by look-up; only in the word's own class are its own tokens taken out of the table."""
        t, (m, k) = self.table, after.shape
        each, size = np.arange(m), after.sum(axis=1)
        p, q = after.copy(), before.copy()
        p[each, at] -= own
        q[each, at] -= own
        total = self.diagonal[p + q, np.arange(k)] - self.size[size]
        stay = np.zeros(m)
        for raw, x, known, side in ((after, p, self.next, t), (before, q, self.last, t.T)):
            w, d = np.nonzero(x)
            n = x[w, d]
            gain = known[n, d]
            gain[np.arange(len(w)), d] = 0
            if len(w):
                first = np.flatnonzero(np.diff(w, prepend=-1))
                total[w[first]] += np.add.reduceat(gain, first)
            home = side[at[w], d] - raw[w, d]
            stay += np.bincount(w, np.where(d == at[w], 0, _xlogx(home + n) - _xlogx(home)), m)
        here = t[at, at] - after[each, at] - before[each, at] + own
        stay += _xlogx(t[at, at]) - _xlogx(here)
        for sums in (self.rows, self.cols):
            stay -= _xlogx(sums[at]) - _xlogx(sums[at] - size)
        total[each, at] = stay
        return total

    def once(self) -> np.ndarray:
        """(K, K, K): the best class of a word that occurs once, by its class, the class after it and the class before it."""
        k = len(self.table)
        at, d, e = (x.ravel() for x in np.indices((k, k, k)))
        possible = self.table[at, d] * self.table[e, at] > 0
        out = at.copy()
        at, d, e = at[possible], d[possible], e[possible]
        eye = np.eye(k, dtype=np.int64)
        gain = self.rare(at, eye[d], eye[e], np.zeros(len(at), np.int64))
        out[possible] = np.where(gain.max(axis=1) > gain[np.arange(len(at)), at] + 1e-9, gain.argmax(axis=1), at)
        return out.astype(np.uint8).reshape(k, k, k)


def likelihood(table: np.ndarray) -> float:
    """The part of the training log-likelihood that the classes decide."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


class Profiles:
    """Sparse profiles of a bucket's words, merged from all chunks: ``code`` and ``count`` of word i lie from ``ends[i]`` to ``ends[i + 1]``."""

    def __init__(self, words: int, width: int, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.count = np.add.reduceat(counts, first) if len(first) else counts
        self.code = keys[first] % width
        self.ends = np.searchsorted(keys[first], np.arange(words + 1) * width)
        self.width = width

    def dense(self, some: np.ndarray) -> np.ndarray:
        a, n = self.ends[some], self.ends[some + 1] - self.ends[some]
        place = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = np.zeros((len(some), self.width), np.int64)
        out[np.repeat(np.arange(len(some)), n), self.code[place]] = self.count[place]
        return out


def move_words(made: DataFrame, numbers: DataFrame, k: int, choose) -> DataFrame:
    """``contexts`` to (bucket, chunk, cls) by choose(classes, totals, profiles) -> new classes; chunk -1 has the words and tokens of each class, and of what moved.

    ``k`` is the number of classes that the contexts are of.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = dict(zip(left.column("chunk").to_pylist(), zip(left.column("ids").to_pylist(), left.column("counts").to_pylist(), strict=True), strict=True))
        bucket, listed, keys, counts, size = None, [], [], [], 0
        for bucket, chunk, cls, profile in zip(*(right.column(c).to_pylist() for c in ("bucket", "chunk", "cls", "profile")), strict=True):
            ids, n = unpack_numbers(own[chunk][0]).astype(np.int64), unpack_longs(own[chunk][1])
            raw = unpack_numbers(profile).astype(np.int64)
            code, count = raw[len(ids) :].reshape(2, -1)
            keys.append(np.repeat(ids, raw[: len(ids)]) * (2 * k + 1) + code)
            counts.append(count)
            listed.append((chunk, ids, n, np.frombuffer(unpack(cls), np.uint8)))
            size = max(size, int(ids.max(initial=-1)) + 1)
        if bucket is None:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary())], names=["bucket", "chunk", "cls"])
        at, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for _, ids, n, cls in listed:
            at[ids], total[ids] = cls, n
        best = choose(at, total, Profiles(size, 2 * k + 1, np.concatenate(keys), np.concatenate(counts)))
        moved = (best != at) & (total > 0)
        sums = np.stack([np.bincount(best, total, 256), np.bincount(best, total > 0, 256), np.bincount(best, moved * total, 256), np.bincount(best, moved, 256)]).astype("<i8")
        data = [pack(best[ids].astype(np.uint8).tobytes()) for _, ids, _, _ in listed]
        return pa.table([pa.array([bucket] * (len(data) + 1), pa.int32()), pa.array([*(x[0] for x in listed), -1], pa.int64()), pa.array([*data, sums.tobytes()], pa.binary())], names=["bucket", "chunk", "cls"])

    members = numbers.where("chunk >= 0").select("bucket", "chunk", "ids", "counts")
    return durable(members.groupBy("bucket").cogroup(made.groupBy("bucket")).applyInArrow(run, STATE))


def placing(place: np.ndarray, other: int):
    """``choose`` for the words outside the core: the class their neighbours make most likely."""

    def choose(at, total, profiles):
        best = at.copy()
        todo = np.flatnonzero(at == other)
        for low in range(0, len(todo), BLOCK):
            some = todo[low : low + BLOCK]
            best[some] = (profiles.dense(some)[:, :-1] @ place).argmax(axis=1)
        return best

    return choose


def exchanging(table: np.ndarray, turn: int, parts: int):
    """``choose`` of one sweep: words whose turn it is go to their best class."""
    k, once = len(table), Gains(table).once()

    def choose(at, total, profiles):
        g, best = Gains(table), at.copy()
        mine = (np.arange(len(at)) % parts == turn % parts) & (total > 0)
        single = np.flatnonzero(mine & (total == 1))
        i = profiles.ends[single]
        best[single] = once[at[single], profiles.code[i], profiles.code[i + 1] - k]
        for todo, gain in ((mine & (total > 1) & (total <= SMALL), g.rare), (mine & (total > SMALL), g.exact)):
            todo = np.flatnonzero(todo)
            for low in range(0, len(todo), 1 << 13):
                some = todo[low : low + (1 << 13)]
                dense = profiles.dense(some)
                found = gain(at[some], dense[:, :k], dense[:, k : 2 * k], dense[:, 2 * k])
                best[some] = np.where(found.max(axis=1) > found[np.arange(len(some)), at[some]] + 1e-9, found.argmax(axis=1), at[some])
        return best

    return choose


def _summed(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sum of packed 64-bit matrices, one a row: within partitions, then in about the square root of their number, then here."""

    def add(batches):
        total = np.zeros(shape[0] * shape[1], np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["x"])

    some = max(1, math.isqrt(partitions(rows.sparkSession)))
    found = rows.mapInArrow(add, "x binary").repartition(some).mapInArrow(add, "x binary").collect()
    return sum((np.frombuffer(bytes(r.x), "<i8").reshape(shape) for r in found), np.zeros(shape, np.int64))


def _sums(state: DataFrame) -> np.ndarray:
    """(4, 256): tokens and words of each class, and the tokens and words that moved there."""
    return _summed(state.where("chunk = -1").select("cls"), (4, 256))


def _table(made: DataFrame, k: int) -> np.ndarray:
    """The class bigrams of all chunks."""
    return _summed(made.where("bucket < 0").select("cls"), (k, k)).astype(np.float64)


def _drop(made: DataFrame) -> None:
    """Delete what ``durable`` wrote, and let Spark's cleaner delete the shuffles of queries that are done, so that sweeps don't add up on disk."""
    jvm = made.sparkSession._jvm
    for file in made.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(made.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    jvm.java.lang.System.gc()


def sweep_all(body: DataFrame, state: DataFrame, numbers: DataFrame, k: int, n: int, buckets: int, passes: int, tolerance: float) -> tuple[DataFrame, np.ndarray]:
    """Exchange sweeps over all words from the clustering ``state``, and the class bigrams in the end; see the module's text."""
    parts, gained, last = PARTS, [], None
    for i in range(passes + 1):
        made = durable(contexts(body, state.where("chunk >= 0"), k, buckets), "uncompressed")
        table = _table(made, k)
        now = likelihood(table)
        if last and now < last[0]:
            _drop(made)
            _drop(state)
            now, state, made, table = last
            parts *= 2
            gained = []
        elif last:
            gained.append((now - last[0]) / n)
            _drop(last[2])
        log.info("sweep %d: mean log-likelihood of a token %.6f", i, now / n)
        if i == passes or len(gained) >= parts and sum(gained[-parts:]) < tolerance:
            _drop(made)
            break
        last = now, state, made, table
        state = move_words(made.where("bucket >= 0"), numbers, k, exchanging(table, i, parts))
        log.info("sweep %d: %d words moved, with %d of %d tokens", i + 1, *_sums(state)[[3, 2]].sum(axis=1).tolist(), n)
    return state, table


@dataclass
class Model:
    """A fitted model: ``spec``, and the tables by chunk that hold the texts and the words' classes and counts."""

    spec: Spec
    chunks: DataFrame
    numbers: DataFrame
    state: DataFrame
    buckets: int


def fit(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = 32, core: int = 500, sweeps: int = 8, passes: int = 20, tolerance: float = 0.01, chunk_bytes: int = CHUNK) -> Model:
    """Learn where ``held`` is false; at most 255 classes."""
    spark = docs.sparkSession
    buckets = max(16, partitions(spark))
    k = classes
    chunks = durable(word_chunks(docs, id_col, text_col, held, buckets, chunk_bytes), "uncompressed")
    numbers = durable(number_words(chunks, core))
    n, v = (x or 0 for x in numbers.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    top = numbers.select(F.explode("top").alias("c")).select("c.*").orderBy(F.desc("n"), "word").limit(core).toArrow().to_pylist()
    words = {r["word"]: i for i, r in enumerate(sorted(top, key=lambda r: (-r["n"], r["word"])))}
    m = len(words)
    pairs = np.zeros((m + 1, m + 1))
    found = core_pairs(chunks, words, buckets).toArrow()
    pairs[found["a"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    cls = exchange(pairs, k, sweeps) if m else np.zeros(0, np.int64)
    member = np.eye(k + 1)[np.array([*cls, k])]
    table = member.T @ pairs @ member
    rows, cols, all_ = table.sum(axis=1) + 1, table.sum(axis=0) + 1, table.sum() + 1
    pmi = np.log((table + 0.1) * all_ / (rows[:, None] * cols[None, :]))
    body = chunks.select("chunk", "held", "lengths", "stream", "classes")
    state = core_state(chunks, words, cls, k)
    # after the word: columns of pmi are the neighbour; before it: rows
    state = move_words(contexts(body, state, k + 1, buckets).where("bucket >= 0"), numbers, k + 1, placing(np.concatenate([pmi[:k].T, pmi[:, :k]]), k))
    table = np.zeros((k, k))
    if n:
        state, table = sweep_all(body, state, numbers, k, n, buckets, passes, tolerance)
    sums = _sums(state)[:2, :k].T
    prior = (sums[:, 0] + 1.0) / (sums[:, 0] + 1.0).sum()
    moves = np.concatenate([(table + prior) / (table.sum(axis=1, keepdims=True) + 1), prior[None, :]])
    return Model(Spec(n, v, sums, moves), chunks, numbers, state.where("chunk >= 0"), buckets)


def word_classes(model: Model) -> DataFrame:
    """(word, class, n): class and training count of every training word."""
    lists = model.chunks.select("chunk", F.posexplode("words").alias("bucket", "words"))
    full = lists.join(model.state, ["chunk", "bucket"]).join(model.numbers, ["chunk", "bucket"]).select("words", "cls", "counts")

    def run(batches):
        for batch in batches:
            for words, cls, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpack_words(words), pa.binary()), pa.array(np.frombuffer(unpack(cls), np.uint8).astype(np.int32)), pa.array(unpack_longs(counts))], ["word", "class", "n"])

    return full.mapInArrow(run, "word binary, class int, n bigint").where("n > 0").distinct()


def score(model: Model, id_col: str = "doc_id", mix: float = 0.95) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every document the model was given."""
    spark, buckets = model.chunks.sparkSession, model.buckets
    shared = spark.sparkContext.broadcast(model.spec)
    schema = T.StructType([T.StructField(id_col, model.chunks.schema["ids"].dataType.elementType), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "perplexity"))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from .bpe import _arrow

        if not left.num_rows:
            return pa.table([pa.array([], type=t) for t in _arrow(schema)], names=schema.names)
        s = shared.value
        own = _by_bucket(right, "cls", "counts")
        cls = np.concatenate([np.frombuffer(unpack(x), np.uint8) for _, x, _ in own if x]).astype(np.int64)
        total = np.concatenate([unpack_longs(x) for _, _, x in own if x])
        x = by_number(left.column("classes")[0].as_py(), buckets)[unpack_numbers(left.column("stream")[0].as_py())]
        count = total[x].astype(np.float64)
        known = count > 0
        c = np.where(known, cls[x], -1)
        lengths = np.array(left.column("lengths")[0].as_py(), np.int64)
        starts = np.cumsum(lengths) - lengths
        before = np.concatenate([[0], c[:-1]])
        before[starts] = c[-1]
        slots = s.sums.sum(axis=1) + 1.0
        unknown = (s.moves / slots).sum(axis=1)
        p = np.where(known, s.moves[before, c] * (count + 1) / slots[c], unknown[before])
        base = (count + 1) / (s.n + s.v + 1)
        add = lambda x: np.add.reduceat(x, starts)
        total = add(np.log10(mix * p + (1 - mix) * base))
        return pa.table([left.column("ids").combine_chunks().flatten(), pa.array(left.column("held")[0].as_py(), pa.bool_()), pa.array(lengths), pa.array(add(known.astype(np.int64))), pa.array(np.full(len(lengths), s.n, np.int64)), pa.array(add(np.log10(base))), pa.array(total), pa.array(10 ** np.minimum(-total / lengths, 300))], names=schema.names)

    known = model.numbers.where("chunk >= 0").select("bucket", "chunk", F.lit(None).cast("binary").alias("cls"), "counts")
    both = model.state.select("bucket", "chunk", "cls", F.lit(None).cast("binary").alias("counts")).unionByName(known)
    body = model.chunks.select("chunk", "ids", "held", "lengths", "stream", "classes")
    return body.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(run, schema)


def fit_and_score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", mix: float = 0.95, **params) -> DataFrame:
    """``fit`` where ``held`` is false, and ``score`` of all documents."""
    return score(fit(docs, held, id_col, text_col, **params), id_col, mix)


def query(spark, sf_dir: str) -> DataFrame:
    return fit_and_score(load(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)
