"""Approximate nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut into halves, each half is quantised by its own codebook, and a vector's cell is its
pair of centroids.  A query walks the pairs by rising summed distance (a heap over the two sorted lists)
until the cells hold ``share`` of all vectors; the vectors of those cells are ranked by their exact
cosine.  Codebooks are fitted on at most ``sample`` vectors and grow with the number of vectors, so that
cells stay small; every vector is indexed.  ``share`` is measured, unless given: the least at which PROBES
vectors of the sample find ``recall`` of their nearest ones within the sample.

Cells are dealt into groups of about ``part`` vectors: small ones share a group with cells beside them, larger
ones are split over several, so that a cell which holds a third of all rows is worked on by many tasks.  A
group answers a query with the best ``k`` of the cells that the query's walk has reached there.  Equal vectors of a part
are compared once.  The cell counts and codebooks that reach the driver are as large as the codebooks, not the data.

Recall against brute force over all vectors is measured in the tests.

Edge cases: vectors that are null, zero, hold null or non-finite components, or are not of the most
common length take no part, as queries or candidates; a null id takes no part either; fewer than k
candidates are all returned; ties go to the smaller id; rows that repeat an id are all searched, and the id
counts with its best score (the query's own id is never a candidate); an empty table gives no rows; further
columns are not looked at.
"""

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, load


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Centroids by Lloyd's algorithm from k-means++ starts; fewer than k if there are fewer points."""
    rng = np.random.default_rng(seed)
    points = np.unique(x, axis=0)
    if len(points) <= k:
        return points
    at = [int(rng.integers(len(x)))]
    near = ((x - x[at[0]]) ** 2).sum(axis=1)
    while len(at) < k:
        at.append(int(rng.choice(len(x), p=near / near.sum())))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(axis=1))
    c = x[at]
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: float) -> list[int]:
    """Cells (i * len(second) + j) by rising first[i] + second[j], until they hold ``enough`` vectors."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    width, held, out = len(second), 0, []
    heap, pushed = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * width + int(b[j])
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


#: Vectors of the sample that are searched for in it, to measure the share.
PROBES = 200
SHARES = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9)


def codebook_size(vectors: int) -> int:
    """Centroids of a half: a power of two from 16 to 256, of which pairs have eight vectors each."""
    return int(np.clip(2 ** int(np.log2(max(vectors, 8) / 8) / 2), 16, 256))


def share_for(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, recall: float) -> float:
    """The least of SHARES, or 1, at which the first PROBES of the unit vectors ``x`` find ``recall`` of their ``k`` nearest others."""
    half, width = books[0].shape[1], len(books[1])
    cell = nearest(x[:, :half], books[0]) * width + nearest(x[:, half:], books[1])
    counts = np.bincount(cell, minlength=len(books[0]) * width)
    probes = x[:PROBES]
    near = probes @ x.T
    near[np.arange(len(probes)), np.arange(len(probes))] = -9
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    wanted = cell[np.argpartition(-near, k - 1, axis=1)[:, :k]]
    first, second = distances(probes[:, :half], books[0]), distances(probes[:, half:], books[1])
    needed = np.zeros(wanted.shape)  # share that is held when the walk reaches the cell
    for i in range(len(probes)):
        way = walk(first[i], second[i], counts, len(x))
        held = dict(zip(way, (np.cumsum(counts[way]) - counts[way]) / len(x), strict=True))
        needed[i] = [held[c] for c in wanted[i]]
    return next((s for s in SHARES if (needed < s).mean() >= recall), 1.0)


def deal_cells(counts: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """First group of each cell, and number of its groups."""
    start, pieces = np.zeros(len(counts), np.int64), np.maximum(-(-counts // part), 1)
    group, filled = 0, 0
    for cell, n in enumerate(counts.tolist()):
        if filled and filled + n > part:
            group, filled = group + 1, 0
        start[cell] = group
        if n > part:
            group, filled = group + int(pieces[cell]), 0
        else:
            filled += n
    return start, pieces


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable_vectors(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """(id, v array<double>) of the vectors that take part, their length and number."""
    v = F.col(vec_col).cast("array<double>")
    t = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    t = t.where(F.col("v").isNotNull() & good)
    length = t.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    dim = length.n if length else 0
    return t.where(F.size("v") == dim), dim, length.c if length else 0


def search(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, share: float | None = None, recall: float = 0.95, centroids: int | None = None, sample: int = 20000, part: int = 500) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found to each row for which ``is_query`` (a condition on ``id_col``) holds."""
    spark = table.sparkSession
    vectors, dim, number = usable_vectors(table, id_col, vec_col)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not dim:
        return empty
    picked = vectors.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(sample).select("v").toArrow()
    x = _matrix(picked["v"].combine_chunks(), dim)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    half = dim // 2
    size = centroids or codebook_size(number)
    books = kmeans(x[:, :half], size), kmeans(x[:, half:], size)
    share = share_for(x, books, k, recall) if share is None else share
    shared = spark.sparkContext.broadcast(books)
    width = len(books[1])
    query = F.col("query")

    def place(batches):
        c1, c2 = shared.value
        for b in batches:
            y = _matrix(b.column(1), dim)
            y = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
            cell = nearest(y[:, :half], c1) * width + nearest(y[:, half:], c2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell, pa.int32())], ["id", "v", "query", "cell"])

    index = durable(vectors.dropDuplicates(["id", "v"]).select("id", "v", is_query.alias("query")).mapInArrow(place, "id bigint, v array<double>, query boolean, cell int"))
    counts = np.zeros(len(books[0]) * width, np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r.cell] = r["count"]
    dealt = spark.sparkContext.broadcast((counts, *deal_cells(counts, part)))

    def ask(batches):
        c1, c2 = shared.value
        n, start, pieces = dealt.value
        for b in batches:
            y = _matrix(b.column(1), dim)
            ids = b.column(0).to_numpy()
            u = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
            first, second = distances(u[:, :half], c1), distances(u[:, half:], c2)
            asks = defaultdict(list)
            for i in range(len(y)):
                for cell in walk(first[i], second[i], n, max(share * n.sum(), k + 1)):
                    for group in range(start[cell], start[cell] + pieces[cell]):
                        asks[group].append((i, cell))
            for group, pairs in asks.items():
                who, own = np.unique([i for i, _ in pairs], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[who].astype("<i8"), y[who], own.astype("<i4"), np.array([c for _, c in pairs], "<i4")))], ["group", "ids", "data", "asker", "cells"])

    def deal(batches):
        _, start, pieces = dealt.value
        for b in batches:
            ids, cell = b.column(0).to_numpy(), b.column(2).to_numpy()
            piece = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % pieces[cell].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(start[cell] + piece.astype(np.int64), pa.int32()), b.column(2), b.column(0), b.column(1)], ["group", "cell", "id", "v"])

    asked = index.where(query).select("id", "v").mapInArrow(ask, "group int, ids binary, data binary, asker binary, cells binary")
    entries = index.select("id", "v", "cell").mapInArrow(deal, "group int, cell int, id bigint, v array<double>")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        ids, y, cell = left.column("id").to_numpy(), _matrix(left.column("v").combine_chunks(), dim), left.column("cell").to_numpy()
        order = np.lexsort((ids, cell, *y.T))
        ids, y, cell = ids[order], y[order], cell[order]
        # of equal vectors of a cell the k + 1 smallest ids are enough for any query
        same = np.concatenate([np.zeros(k + 1, bool), (y[k + 1 :] == y[: -k - 1]).all(axis=1) & (cell[k + 1 :] == cell[: -k - 1])]) if len(y) > k + 1 else np.zeros(len(y), bool)
        ids, y, cell = ids[~same], y[~same], cell[~same]
        cells, own_cell = np.unique(cell, return_inverse=True)
        norm = np.sqrt((y * y).sum(axis=1))
        repeated = len(np.unique(ids)) < len(ids)
        out = [], [], []
        for own, data, asker, wanted in zip(*(right.column(c).to_pylist() for c in ("ids", "data", "asker", "cells")), strict=True):
            own, q = np.frombuffer(own, "<i8"), np.frombuffer(data).reshape(-1, dim)
            asker, wanted = np.frombuffer(asker, "<i4"), np.frombuffer(wanted, "<i4")
            there = np.isin(wanted, cells)  # a piece of a cell may have got no vector
            looks = np.zeros((len(q), len(cells)), bool)
            looks[asker[there], np.searchsorted(cells, wanted[there])] = True
            rough = (q / np.sqrt((q * q).sum(axis=1, keepdims=True))) @ (y / norm[:, None]).T
            rough = np.where(looks[:, own_cell] & (ids[None, :] != own[:, None]), rough, -9.0)
            for i in range(len(q)):
                r = rough[i]
                least = np.partition(r, -k)[-k] if len(r) > k and not repeated else -2.0
                near = np.flatnonzero((r >= least - 1e-9) & (r > -5))
                # one product and sum per pair, so that equal vectors get equal scores
                exact = (y[near] * q[i]).sum(axis=1) / (norm[near] * np.sqrt((q[i] * q[i]).sum()))
                best = np.lexsort((ids[near], -exact))
                if repeated:
                    best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])]
                best = best[:k]
                out[0].extend([own[i]] * len(best))
                out[1].extend(ids[near][best])
                out[2].extend(exact[best])
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    found = entries.groupBy("group").cogroup(asked.groupBy("group")).applyInArrow(rank, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
