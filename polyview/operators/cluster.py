"""Multi-view k-means, spherical k-means and spectral clustering."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.gram import summed
from ..plans.pairs import Affinities, Laplacians, roots


class MultiviewKMeans:
    """Co-EM k-means of two views: the M step of a view uses the other view's partition.

    An iteration is one pass that sums rows and counts per cluster, for all runs at once.  A run stops when the summed distance
    has not fallen by ``tol`` of itself for ``patience`` rounds; the best of ``n_init`` runs stays.
    ``init`` may be a list of two centroid arrays.
    """

    spherical = False

    def __init__(self, n_clusters=2, random_state=None, init="k-means++", patience=5, max_iter=300, n_init=5, tol=1e-4):
        self.n_clusters, self.random_state, self.init, self.patience = n_clusters, random_state, init, patience
        self.max_iter, self.n_init, self.tol = max_iter, n_init, tol

    def _scaled(self, mv):
        return mv.with_views([X.unit(v) for v in mv.cols()], mv.dims) if self.spherical else mv

    def _distances(self, x, c):
        if self.spherical:
            return 1 - x @ c.T
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0))

    def _starts(self, mv, rng) -> list[list[np.ndarray]]:
        """Centroids of both views for each run; all runs share their passes."""
        if not isinstance(self.init, str):
            out = [np.asarray(c, float) for c in self.init]
            if len(out) != 2 or any(c.shape != (self.n_clusters, d) for c, d in zip(out, mv.dims, strict=True)):
                raise ValueError("init must hold n_clusters centroids for each view")
            return [out]
        seeds = [int(rng.integers(1 << 31)) for _ in range(self.n_init)]
        cut, k = mv.dims[0], self.n_clusters
        if mv.df.limit(k).count() < k:
            raise ValueError("fewer samples than clusters")
        if self.init == "random":
            rows = [mv.df.select(mv.key, *mv.views).orderBy(F.xxhash64(F.col(mv.key), F.lit(seed)), mv.key).limit(k).collect() for seed in seeds]
            return [[np.array([r[v] for r in run]) for v in mv.views] for run in rows]
        first = mv.df.agg(*[F.min_by(F.concat(*mv.views), F.struct(F.xxhash64(F.col(mv.key), F.lit(seed)), mv.key)).alias(f"r{i}") for i, seed in enumerate(seeds)]).first()
        picked = [np.array([r]) for r in first]
        for _ in range(1, k):  # farthest first on the second view; of equals the least row
            def part(x, picked=picked):
                out = []
                for p in picked:
                    gap = ((x[:, None, cut:] - p[None, :, cut:]) ** 2).sum(-1).min(axis=1)
                    far = np.flatnonzero(gap == gap.max())
                    out.append(np.concatenate([gap[far[:1]], min(x[far].tolist())]))
                return out

            def better(a, b):
                return [x if (-x[0], x[1:].tolist()) <= (-y[0], y[1:].tolist()) else y for x, y in zip(a, b, strict=True)]

            picked = [np.vstack([p, row[1:]]) for p, row in zip(picked, summed(mv, part, better), strict=True)]
        return [[p[:, :cut], p[:, cut:]] for p in picked]

    def _runs(self, mv, starts) -> list[tuple[float, list[np.ndarray]]]:
        """(least loss, its centroids) of each run; a pass advances all runs that have not stopped."""
        cut, k = mv.dims[0], self.n_clusters
        now, best, kept, idle = list(starts), [np.inf] * len(starts), list(starts), [0] * len(starts)
        going = list(range(len(starts)))
        for _ in range(self.max_iter or 10_000):
            def part(x, held=tuple(now[r] for r in going)):
                out = []
                for c in held:
                    far = [self._distances(x[:, :cut], c[0]), self._distances(x[:, cut:], c[1])]
                    for view, rows in enumerate((x[:, :cut], x[:, cut:])):
                        labels = far[1 - view].argmin(axis=1)
                        sums = np.zeros((k, rows.shape[1]))
                        np.add.at(sums, labels, rows)
                        out += [sums, np.bincount(labels, minlength=k).astype(float), np.array([far[view].min(axis=1).sum()])]
                return out

            s = summed(mv, part)
            left = []
            for i, r in enumerate(going):
                own = s[6 * i : 6 * i + 6]
                loss = float(own[2][0] + own[5][0])
                if loss < best[r] * (1 - self.tol) or best[r] == np.inf:
                    best[r], kept[r], idle[r] = loss, now[r], 0
                else:
                    idle[r] += 1
                    if idle[r] >= self.patience:
                        continue
                new = []
                for view in (0, 1):
                    sums, counts = own[3 * view], own[3 * view + 1]
                    m = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], now[r][view])
                    new.append(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if self.spherical else m)
                now[r] = new
                left.append(r)
            going = left
            if not going:
                break
        return list(zip(best, kept, strict=True))

    def fit(self, mv):
        if not isinstance(self.n_clusters, int) or self.n_clusters < 1:
            raise ValueError("n_clusters must be a positive integer")
        if isinstance(self.init, str) and self.init not in ("k-means++", "random"):
            raise ValueError("init must be k-means++, random or centroids")
        with self._scaled(mv.checked(enforce_views=2)).pinned() as mv:
            return self._fit(mv)

    def _fit(self, mv):
        runs = self._runs(mv, self._starts(mv, np.random.default_rng(self.random_state)))
        self.inertia_, c = min(runs, key=lambda r: r[0])
        cut = mv.dims[0]

        def part(x):
            a, b = self._distances(x[:, :cut], c[0]).argmin(1), self._distances(x[:, cut:], c[1]).argmin(1)
            same = x[a == b]
            sums = np.zeros((self.n_clusters, x.shape[1]))
            np.add.at(sums, a[a == b], same)
            return [sums, np.bincount(a[a == b], minlength=self.n_clusters).astype(float)]

        sums, counts = summed(mv, part)
        there = counts > 0
        if not there.any():
            warnings.warn("the views agree on no sample; there are no centroids", stacklevel=2)
            self.centroids_ = [None, None]
            return self
        if not there.all():
            warnings.warn("some clusters have no sample on which the views agree", stacklevel=2)
        m = sums[there] / counts[there][:, None]
        self.centroids_ = [m[:, :cut], m[:, cut:]]
        if self.spherical:
            self.centroids_ = [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in self.centroids_]
        return self

    def predict(self, mv) -> DataFrame:
        if not hasattr(self, "centroids_"):
            raise ValueError("fit first")
        if self.centroids_[0] is None:
            raise AttributeError("there are no centroids")
        mv = self._scaled(mv)
        far = (lambda v, c: 1 - X.dot(v, c)) if self.spherical else (lambda v, c: F.sqrt(X.sqdist(v, c)))
        a, b = mv.cols()
        total = [far(a, X.vector(p)) + far(b, X.vector(q)) for p, q in zip(*self.centroids_, strict=True)]
        return mv.df.select(*mv.keep(), X.argmin(total).alias("cluster"))

    def fit_predict(self, mv):
        return self.fit(mv).predict(mv)


class MultiviewSphericalKMeans(MultiviewKMeans):
    """Co-EM k-means on unit rows with distance 1 - cosine."""

    spherical = True


def kmeans(x: np.ndarray, k: int, n_init: int = 10, seed=None) -> np.ndarray:
    """Labels of ordinary k-means on a small array."""
    rng, best = np.random.default_rng(seed), (np.inf, None)
    for _ in range(n_init):
        c = x[[int(rng.integers(len(x)))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(-1).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(100):
            d = ((x[:, None] - c[None]) ** 2).sum(-1)
            own = d.argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        loss = d.min(1).sum()
        if loss < best[0]:
            best = (loss, own)
    return best[1]


class MultiviewSpectralClustering:
    """Co-training spectral clustering: each view's affinity is projected on the other views' leading eigenvectors.

    Affinities are computed anew in every pass over all pairs of rows, so no n x n matrix is held (``plans.pairs``);
    projected ones have low rank, and their eigenvectors come from one pass.  Time grows with the square of the rows.
    """

    def __init__(self, n_clusters=2, random_state=None, info_view=None, max_iter=10, n_init=10, affinity="rbf", gamma=None, n_neighbors=10):
        self.n_clusters, self.random_state, self.info_view, self.max_iter = n_clusters, random_state, info_view, max_iter
        self.n_init, self.affinity, self.gamma, self.n_neighbors = n_init, affinity, gamma, n_neighbors
        for name in ("n_clusters", "max_iter", "n_init", "n_neighbors"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 1:
                raise ValueError(f"{name} must be a positive integer")
        if affinity not in ("rbf", "nearest_neighbors", "poly"):
            raise ValueError("affinity must be rbf, nearest_neighbors or poly")
        if gamma is not None and gamma <= 0:
            raise ValueError("gamma must be positive")

    def _collect(self, mv):
        mv = mv.checked(multiview=True)
        rows = mv.df.select(mv.key, *mv.views).orderBy(mv.key).toArrow()
        xs = [rows[v].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1) for v in mv.views]
        return rows[mv.key].to_pylist(), xs

    def leading(self, y, u):
        """Leading eigenvectors of the normalised (y u' + u y') / 2."""
        d = roots((y @ u.sum(axis=0) + u @ y.sum(axis=0)) / 2)[:, None]
        q, r = np.linalg.qr(np.hstack([y, u]) / d)
        a, b = np.hsplit(r, 2)
        vals, vecs = np.linalg.eigh((a @ b.T + b @ a.T) / 2)
        return q @ vecs[:, np.argsort(-np.abs(vals), kind="stable")[: self.n_clusters]]

    def embed(self, affinities):
        views = range(len(affinities.xs))
        laps = Laplacians(affinities)
        us = []
        for v in views:
            us.append(laps.leading(v, self.n_clusters)[0])
            laps.drop(v)
        for _ in range(self.max_iter):
            others = {v: np.hstack([u for w, u in enumerate(us) if w != v]) for v in views}
            projected = affinities.times(others)
            us = [self.leading(projected[v], others[v]) for v in views]
        return us

    def fit_predict(self, mv) -> DataFrame:
        keys, xs = self._collect(mv)
        if self.info_view is not None and not 0 <= self.info_view < len(xs):
            raise ValueError("info_view is no view")
        affinities = Affinities(mv.df.sparkSession, xs, self.affinity, self.gamma, self.n_neighbors)
        del xs
        us = [u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300) for u in self.embed(affinities)]
        affinities.close()
        self.embedding_ = np.hstack(us) if self.info_view is None else us[self.info_view]
        labels = kmeans(self.embedding_, self.n_clusters, self.n_init, self.random_state)
        return mv.df.sparkSession.createDataFrame(list(zip(keys, map(int, labels), strict=True)), f"{mv.key} {dict(mv.df.dtypes)[mv.key]}, cluster int")


class MultiviewCoRegSpectralClustering(MultiviewSpectralClustering):
    """Pairwise co-regularised spectral clustering: eigenvectors of L_v + lambda * sum of the other views' projectors."""

    def __init__(self, n_clusters=2, v_lambda=2, **params):
        super().__init__(n_clusters, **params)
        if v_lambda <= 0:
            raise ValueError("v_lambda must be positive")
        self.v_lambda = v_lambda

    def embed(self, affinities):
        laps, views = Laplacians(affinities), range(len(affinities.xs))
        found = [laps.leading(v, self.n_clusters) for v in views]
        us, objective = [found[v][0] for v in views], [[np.abs(found[v][1]).sum() for v in views]]
        for _ in range(1, self.max_iter):
            row = [0.0] * len(us)
            for v in [*views[1:], 0]:
                others = np.hstack([u for w, u in enumerate(us) if w != v])
                laps.grow(v, others.copy())
                us[v], values = laps.leading(v, self.n_clusters, others, self.v_lambda, 2 * self.n_clusters)
                row[v] = np.abs(values).sum()
            objective.append(row)
        self.objective_ = np.array(objective).T
        return us
