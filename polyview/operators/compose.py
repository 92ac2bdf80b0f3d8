"""Splitting, merging and generating views, and per-view wrappers."""

from __future__ import annotations

import copy
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import MultiviewFrame
from ..functions import exprs as X
from ..plans.gram import gram


def check_n_views(n) -> int:
    if not isinstance(n, int) or n < 1:
        raise ValueError(f"n_views must be a positive integer, not {n}")
    return n


def check_n_features(k, d: int) -> int:
    """A number of features, or a share below one."""
    if k is None or k <= 0 or (k >= 1 and int(k) != k) or k > d:
        raise ValueError(f"{k} is no number or share of {d} features")
    return int(k * d) if k < 1 else int(k)


class Step:
    """fit returns the step itself; fit_transform chains."""

    def fit(self, mv: MultiviewFrame):
        return self

    def fit_transform(self, mv: MultiviewFrame):
        return self.fit(mv).transform(mv)


class SimpleSplitter(Step):
    """One vector to views of the given widths, in order."""

    def __init__(self, n_features):
        self.n_features = list(n_features)

    def transform(self, mv: MultiviewFrame) -> MultiviewFrame:
        v, at, out = mv.cols()[0], 1, []
        if mv.dims and mv.dims[0] != sum(self.n_features):
            raise ValueError(f"expected {sum(self.n_features)} features, got {mv.dims[0]}")
        for w in self.n_features:
            out.append(F.slice(v, at, w))
            at += w
        return mv.with_views(out, self.n_features)

    def inverse_transform(self, mv: MultiviewFrame) -> MultiviewFrame:
        if mv.dims and list(mv.dims) != self.n_features:
            raise ValueError(f"expected widths {self.n_features}, got {list(mv.dims)}")
        return mv.with_views([F.concat(*mv.cols())], [sum(self.n_features)])


class ConcatMerger(Step):
    """Views side by side in one vector."""

    def fit(self, mv):
        self.dims_ = (mv if mv.dims else mv.checked()).dims
        return self

    def transform(self, mv):
        if mv.dims and mv.dims != self.dims_:
            raise ValueError(f"expected widths {self.dims_}, got {mv.dims}")
        return mv.with_views([F.concat(*mv.cols())], [sum(self.dims_)])

    def inverse_transform(self, mv):
        return SimpleSplitter(self.dims_).transform(mv)


class AverageMerger(Step):
    """Element-wise mean of views of equal width."""

    def fit(self, mv):
        self.dims_ = (mv if mv.dims else mv.checked()).dims
        if len(set(self.dims_)) > 1:
            raise ValueError("views must have equal widths")
        return self

    def transform(self, mv):
        n, out = len(mv.views), mv.cols()[0]
        for v in mv.cols()[1:]:
            out = F.zip_with(out, v, lambda a, b: a + b)
        return mv.with_views([F.transform(out, lambda x: x / n)], self.dims_[:1])


class RandomSubspaceMethod(Step):
    """Each view is a random subset of the features."""

    def __init__(self, n_views, subspace_dim, random_state=None):
        self.n_views, self.subspace_dim, self.random_state = check_n_views(n_views), subspace_dim, random_state

    def fit(self, mv):
        d = (mv if mv.dims else mv.checked()).dims[0]
        k, rng = check_n_features(self.subspace_dim, d), np.random.default_rng(self.random_state)
        self.subspace_indices_ = [rng.choice(d, k, replace=False) for _ in range(self.n_views)]
        return self

    def transform(self, mv):
        v = mv.cols()[0]
        return mv.with_views([F.array(*[v[int(i)] for i in ids]) for ids in self.subspace_indices_], [len(i) for i in self.subspace_indices_])


class RandomGaussianProjection(Step):
    """Independent Gaussian projections; 'auto' takes the Johnson-Lindenstrauss width."""

    def __init__(self, n_views, n_components="auto", eps=0.1, random_state=None):
        self.n_views, self.n_components, self.eps, self.random_state = check_n_views(n_views), n_components, eps, random_state

    def fit(self, mv):
        mv = mv.checked()
        k = self.n_components
        if k == "auto":
            k = int(4 * math.log(mv.df.count()) / (self.eps**2 / 2 - self.eps**3 / 3))
            if k > mv.dims[0]:
                raise ValueError(f"eps {self.eps} asks for {k} components of {mv.dims[0]} features")
        rng = np.random.default_rng(self.random_state)
        self.matrices_ = [rng.standard_normal((mv.dims[0], k)) / math.sqrt(k) for _ in range(self.n_views)]
        return self

    def transform(self, mv):
        return mv.with_views([X.project(mv.cols()[0], m) for m in self.matrices_], [m.shape[1] for m in self.matrices_])


class _PerView:
    def __init__(self, base_estimator):
        self.base_estimator = base_estimator

    def _each(self, n: int):
        if isinstance(self.base_estimator, list):
            if len(self.base_estimator) != n:
                raise ValueError(f"{len(self.base_estimator)} estimators for {n} views")
            return [copy.deepcopy(e) for e in self.base_estimator]
        return [copy.deepcopy(self.base_estimator) for _ in range(n)]

    def _one(self, mv, i):
        return MultiviewFrame(mv.df, mv.key, (mv.views[i],), mv.label, mv.dims[i : i + 1])


class ViewTransformer(_PerView, Step):
    """A transformer per view: objects with fit(frame of one view), and transform/inverse_transform of a column."""

    def fit(self, mv):
        mv = mv if mv.dims else mv.checked()
        self.estimators_ = [e.fit(self._one(mv, i)) for i, e in enumerate(self._each(len(mv.views)))]
        return self

    def _apply(self, mv, index, name):
        own = self.estimators_ if index is None else [self.estimators_[i] for i in np.atleast_1d(index)]
        if len(own) != len(mv.views):
            raise ValueError(f"{len(mv.views)} views for {len(own)} estimators")
        return mv.with_views([getattr(e, name)(v) for e, v in zip(own, mv.cols(), strict=True)])

    def transform(self, mv, index=None):
        return self._apply(mv, index, "transform_column")

    def inverse_transform(self, mv, index=None):
        return self._apply(mv, index, "inverse_column")


class ViewClassifier(_PerView):
    """A classifier per view and a majority vote; the smallest label wins ties."""

    def fit(self, mv):
        mv = mv if mv.dims else mv.checked()
        self.estimators_ = [e.fit(self._one(mv, i)) for i, e in enumerate(self._each(len(mv.views)))]
        return self

    def predict(self, mv) -> DataFrame:
        votes = F.array(*[e.predict_column(v) for e, v in zip(self.estimators_, mv.cols(), strict=True)])
        return mv.df.select(*mv.keep(), X.majority(votes).alias("prediction"))

    def score(self, mv) -> float:
        return self.predict(mv).agg(F.avg((F.col(mv.label) == F.col("prediction")).cast("double"))).first()[0]


class PCA(Step):
    """Principal components from the scatter matrix."""

    def __init__(self, n_components=None, whiten=False):
        self.n_components, self.whiten = n_components, whiten

    def fit(self, mv):
        g = gram(mv)
        svals, vecs = _pca(g.scatter, self.n_components)
        self.mean_, self.components_, self.explained_variance_ = g.mean, vecs, svals**2 / max(g.n - 1, 1)
        return self

    @property
    def scale_(self):
        return np.sqrt(self.explained_variance_) if self.whiten else np.ones_like(self.explained_variance_)

    def transform_column(self, v):
        return X.project(v, self.components_ / self.scale_, self.mean_)

    def inverse_column(self, s):
        return F.zip_with(X.project(s, (self.components_ * self.scale_).T), X.vector(self.mean_), lambda a, b: a + b)

    def transform(self, mv):
        return mv.with_views([self.transform_column(mv.cols()[0])], [self.components_.shape[1]])


def _pca(scatter: np.ndarray, k=None):
    from ..functions.linalg import eigh

    vals, vecs = eigh(scatter)
    svals = np.sqrt(np.maximum(vals, 0))
    if k is not None and 0 < k < 1:
        k = int(np.searchsorted(np.cumsum(vals) / vals.sum(), k) + 1)
    return svals[:k], vecs[:, :k]


class Pipeline:
    """Steps in a row; the last may be any estimator."""

    def __init__(self, steps):
        self.steps = list(steps)

    def fit(self, mv):
        for s in self.steps[:-1]:
            mv = s.fit_transform(mv)
        self.steps[-1].fit(mv)
        return self

    def _before(self, mv):
        for s in self.steps[:-1]:
            mv = s.transform(mv)
        return mv

    def transform(self, mv):
        return self.steps[-1].transform(self._before(mv))

    def predict(self, mv):
        return self.steps[-1].predict(self._before(mv))

    def score(self, mv):
        return self.steps[-1].score(self._before(mv))
