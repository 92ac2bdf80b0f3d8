"""Co-training with partly observed labels; an unlabelled row has a null label."""

from __future__ import annotations

import copy
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import MultiviewFrame
from ..functions import exprs as X
from ..functions.linalg import blocks
from ..plans.gram import summed


def class_moments(mv: MultiviewFrame) -> tuple[list, list[list[list]]]:
    """Classes in order, and for each view and class [count, mean, sum of squared deviations]: one pass over the labelled rows."""
    labelled = mv.df.where(F.col(mv.label).isNotNull())
    classes = [r[0] for r in labelled.select(mv.label).distinct().orderBy(mv.label).collect()]
    if not classes:
        raise ValueError("no row has a label")
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(mv.label)).cast("double")
    coded = labelled.select(mv.key, *mv.views, F.array(code).alias("__class"))
    k, at = len(classes), blocks(mv.dims)

    def part(x):
        out = []
        for c in range(k):
            rows = x[x[:, -1] == c + 1, :-1]
            m = rows.mean(axis=0) if len(rows) else np.zeros(x.shape[1] - 1)
            out += [np.array([float(len(rows))]), m, ((rows - m) ** 2).sum(axis=0)]
        return out

    def merge(a, b):
        return [y for c in range(k) for y in merge_moments(a[3 * c : 3 * c + 3], b[3 * c : 3 * c + 3])]

    s = summed(MultiviewFrame(coded, mv.key, (*mv.views, "__class"), None, (*mv.dims, 1)), part, merge)
    return classes, [[[s[3 * c], s[3 * c + 1][r], s[3 * c + 2][r]] for c in range(k)] for r in at]


def merge_moments(a: list, b: list) -> list:
    """Counts, means and squared deviations of the rows of both; large means cost no digits."""
    n = a[0] + b[0]
    share, d = b[0] / np.maximum(n, 1), b[1] - a[1]
    return [n, a[1] + d * share, a[2] + b[2] + d * d * (a[0] * share)]


class GaussianNB:
    """Gaussian naive Bayes from counts, means and squared deviations per class; scoring is a projection."""

    def __init__(self, var_smoothing=1e-9):
        self.var_smoothing = var_smoothing

    def fit(self, mv: MultiviewFrame):
        self.classes_, stats = class_moments(MultiviewFrame(mv.df, mv.key, mv.views[:1], mv.label, mv.dims[:1]))
        return self.from_stats(stats[0])

    def from_stats(self, stats):
        n = np.array([s[0][0] for s in stats])
        var = np.array([s[2] for s in stats]) / n[:, None]
        total = reduce(merge_moments, stats)
        self.theta_, self.prior_ = np.array([s[1] for s in stats]), n / n.sum()
        self.var_ = var + self.var_smoothing * (total[2] / total[0]).max()
        return self

    def joint(self, x: np.ndarray) -> np.ndarray:
        return np.stack([math.log(p) - 0.5 * (np.log(2 * np.pi * v).sum() + ((x - m) ** 2 / v).sum(axis=1)) for p, m, v in zip(self.prior_, self.theta_, self.var_, strict=True)], axis=1)

    def proba(self, x):
        z = self.joint(x)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def joint_columns(self, v):
        out = []
        for p, m, s in zip(self.prior_, self.theta_, self.var_, strict=True):
            gap = F.zip_with(X.subtract(v, X.vector(m)), X.vector(s), lambda d, w: d * d / w)
            out.append(F.lit(math.log(p) - 0.5 * float(np.log(2 * np.pi * s).sum())) - 0.5 * X.total(gap))
        return out

    def proba_columns(self, v):
        z = self.joint_columns(v)
        top = F.greatest(*z) if len(z) > 1 else z[0]
        e = [F.exp(x - top) for x in z]
        return [x / sum(e[1:], e[0]) for x in e]

    def predict_column(self, v):
        z = F.array(*self.joint_columns(v))
        return F.element_at(F.array(*[F.lit(c) for c in self.classes_]), F.array_position(z, F.array_max(z)).cast("int"))


class _Held:
    """A driver-side estimator with fit(X, y), refitted as rows are added."""

    def __init__(self, estimator, x, y):
        self.estimator, self.x, self.y = copy.deepcopy(estimator), x, y

    def add(self, x, y):
        self.x, self.y = np.vstack([self.x, x]), np.append(self.y, y)

    def fitted(self):
        self.estimator.fit(self.x, self.y)
        return self.estimator


def labelled_rows(mv: MultiviewFrame, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Views and labels of the labelled rows by key; more than ``most`` is an error."""
    rows = mv.df.where(F.col(mv.label).isNotNull()).select(mv.key, *mv.views, mv.label).orderBy(mv.key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labelled rows")
    return [np.array([r[v] for r in rows]) for v in mv.views], np.array([r[mv.label] for r in rows])


def queue_of(mv: MultiviewFrame, most: int, seed: int) -> list[list[np.ndarray]]:
    """At most ``most`` unlabelled rows in the order of a hash of the key."""
    rows = mv.df.where(F.col(mv.label).isNull()).orderBy(F.xxhash64(F.col(mv.key), F.lit(seed)), mv.key).limit(most).select(*mv.views).collect()
    return [[np.array(r[v]) for v in mv.views] for r in rows]


def map_views(mv: MultiviewFrame, out: str, kind, f) -> DataFrame:
    """Key, label and a column ``out`` of Spark type ``kind`` by f(list of arrays) -> Arrow array, a map over batches."""
    from pyspark.sql.pandas.types import to_arrow_type

    keep, arrow = mv.keep(), to_arrow_type(kind)
    n = len(keep)

    def run(batches):
        for b in batches:
            xs = [c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in b.columns[n:]]
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:n], f(xs).cast(arrow)], [*keep, out])

    schema = T.StructType([mv.df.schema[c] for c in keep] + [T.StructField(out, kind)])
    return mv.df.select(*keep, *mv.views).mapInArrow(run, schema)


class CTClassifier:
    """Blum-Mitchell co-training of two classifiers on two classes.

    By default both are naive Bayes: labelled rows enter as moments per class (one pass).  Other estimators,
    with fit(X, y) and predict_proba(X), are fitted on the driver; their labelled rows must fit it
    (``max_labelled`` rows, else an error), and prediction is a map over Arrow batches.  The pool and its
    refills are at most pool + num_iter * 2 (p + n) rows, taken in the order of a hash of the key.
    """

    def __init__(self, p=None, n=None, unlabeled_pool_size=75, num_iter=50, random_state=0, estimator1=None, estimator2=None, max_labelled=100_000):
        for e in (estimator1, estimator2):
            if e is not None and not (hasattr(e, "fit") and hasattr(e, "predict_proba")):
                raise AttributeError("estimators need fit and predict_proba")
        self.estimator1, self.estimator2, self.max_labelled = estimator1, estimator2 if estimator2 is not None else estimator1, max_labelled
        for name, v in (("p", p), ("n", n)):
            if v is not None and v <= 0:
                raise ValueError(f"{name} must be positive")
        if (p is None) != (n is None):
            raise ValueError("give both p and n or neither")
        if unlabeled_pool_size <= 0 or num_iter <= 0:
            raise ValueError("unlabeled_pool_size and num_iter must be positive")
        self.p, self.n, self.unlabeled_pool_size, self.num_iter, self.random_state = p, n, unlabeled_pool_size, num_iter, random_state

    def fit(self, mv):
        mv = mv.checked(enforce_views=2).checked_labels(max_classes=2)
        self.classes_, stats = class_moments(mv)
        counts = [s[0][0] for s in stats[0]]
        n, p = self.n, self.p
        if p is None and len(counts) == 2:
            p, n = max(1, int(counts[1] // counts[0])), max(1, int(counts[0] // counts[1]))
        self.p_, self.n_ = p, n
        given = (self.estimator1, self.estimator2)
        held = [None, None]
        if any(e is not None for e in given):
            xs, y = labelled_rows(mv, self.max_labelled)
            held = [None if e is None else _Held(e, x, y) for e, x in zip(given, xs, strict=True)]

        def model(view):
            return GaussianNB().from_stats(stats[view]) if held[view] is None else held[view].fitted()

        if len(self.classes_) == 2:
            queue = queue_of(mv, self.unlabeled_pool_size + self.num_iter * 2 * (p + n), self.random_state)
            pool = [queue.pop(0) for _ in range(min(self.unlabeled_pool_size, len(queue)))]
            for _ in range(self.num_iter):
                if not pool:
                    break
                chosen: dict[int, int] = {}
                for view in (0, 1):
                    m, x = model(view), np.array([x[view] for x in pool])
                    prob = m.proba(x) if held[view] is None else np.asarray(m.predict_proba(x))
                    for c, k in ((0, n), (1, p)):
                        for i in np.argsort(-prob[:, c], kind="stable")[:k]:
                            if prob[i, c] > 0.5:
                                chosen[int(i)] = c
                if not chosen:
                    break
                for i, c in chosen.items():
                    for view in (0, 1):
                        if held[view] is None:
                            stats[view][c] = merge_moments(stats[view][c], [np.ones(1), pool[i][view], np.zeros_like(pool[i][view])])
                        else:
                            held[view].add(pool[i][view], self.classes_[c])
                pool = [x for i, x in enumerate(pool) if i not in chosen]
                pool += [queue.pop(0) for _ in range(min(len(chosen), len(queue)))]
        self.models_ = [model(view) for view in (0, 1)]
        for m, h in zip(self.models_, held, strict=True):
            if h is None:
                m.classes_ = self.classes_
        self.plain_ = all(h is None for h in held)
        return self

    def _proba(self, mv):
        a, b = (m.proba_columns(v) for m, v in zip(self.models_, mv.cols(), strict=True))
        return [(x + y) / 2 for x, y in zip(a, b, strict=True)]

    def _mapped(self, mv, out, kind, f) -> DataFrame:
        shared = mv.df.sparkSession.sparkContext.broadcast(self.models_)
        proba = lambda m, x: m.proba(x) if isinstance(m, GaussianNB) else np.asarray(m.predict_proba(x))
        return map_views(mv, out, kind, lambda xs: f([proba(m, x) for m, x in zip(shared.value, xs, strict=True)]))

    def predict_proba(self, mv) -> DataFrame:
        if not self.plain_:
            return self._mapped(mv, "proba", T.ArrayType(T.DoubleType()), lambda ps: pa.array(((ps[0] + ps[1]) / 2).tolist(), pa.list_(pa.float64())))
        return mv.df.select(*mv.keep(), F.array(*self._proba(mv)).alias("proba"))

    def predict(self, mv) -> DataFrame:
        """Where the views agree that label, else the one of larger summed probability."""
        if not self.plain_:
            classes = self.classes_
            return self._mapped(mv, "prediction", mv.df.schema[mv.label].dataType, lambda ps: pa.array([classes[i] if i == j else classes[k] for i, j, k in zip(ps[0].argmax(1), ps[1].argmax(1), (ps[0] + ps[1]).argmax(1), strict=True)]))
        mean = F.array(*self._proba(mv))
        best = F.element_at(F.array(*[F.lit(c) for c in self.classes_]), F.array_position(mean, F.array_max(mean)).cast("int"))
        a, b = (m.predict_column(v) for m, v in zip(self.models_, mv.cols(), strict=True))
        return mv.df.select(*mv.keep(), F.when(a == b, a).otherwise(best).alias("prediction"))

    def fit_predict(self, mv):
        return self.fit(mv).predict(mv)


class CTRegressor:
    """COREG (Zhou and Li 2005): two k-nearest-neighbour regressors teach each other.

    ``k_neighbors`` may be a pair, one number for each view's regressor.
    The labelled rows are the model; they must fit the driver (``max_labelled`` rows, else an error).  The
    unlabelled pool and its refills are bounded by pool size and rounds.  Prediction is a map over Arrow batches.
    """

    def __init__(self, k_neighbors=5, unlabeled_pool_size=50, num_iter=100, random_state=0, max_labelled=100_000):
        ks = list(k_neighbors) if isinstance(k_neighbors, (list, tuple)) else [k_neighbors] * 2
        if min(*ks, unlabeled_pool_size, num_iter) <= 0 or len(ks) != 2:
            raise ValueError("k_neighbors, unlabeled_pool_size and num_iter must be positive")
        self.ks = ks
        self.k_neighbors, self.unlabeled_pool_size, self.num_iter, self.random_state, self.max_labelled = k_neighbors, unlabeled_pool_size, num_iter, random_state, max_labelled

    @staticmethod
    def _knn(x, y, q, k):
        d = ((q[:, None] - x[None]) ** 2).sum(-1)
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        return y[near].mean(axis=1), near

    def _gain(self, x, y, u, k):
        k = min(k, len(y))
        guess, near = self._knn(x, y, u[None], k)
        near = near[0]
        before = self._knn(x, y, x[near], k)[0]
        after = self._knn(np.vstack([x, u]), np.append(y, guess), x[near], k)[0]
        return float(((y[near] - before) ** 2 - (y[near] - after) ** 2).mean()), float(guess[0])

    def fit(self, mv):
        mv = mv.checked(enforce_views=2)
        xs, y = labelled_rows(mv, self.max_labelled)
        sets = [[x, y.astype(float)] for x in xs]
        queue = queue_of(mv, self.unlabeled_pool_size + 2 * self.num_iter, self.random_state)
        pool = [queue.pop(0) for _ in range(min(self.unlabeled_pool_size, len(queue)))]
        for _ in range(self.num_iter):
            picks: list = []
            ranked = []
            for view in (0, 1):
                gains = [(*self._gain(*sets[view], u[view], self.ks[view]), i) for i, u in enumerate(pool)]
                ranked.append(sorted((g for g in gains if g[0] > 0), key=lambda g: (-g[0], g[2])))
            if ranked[0] and ranked[1] and ranked[0][0][2] == ranked[1][0][2]:
                loser = 0 if ranked[0][0][0] < ranked[1][0][0] else 1
                ranked[loser] = ranked[loser][1:]
            picks = [(view, r[0]) for view, r in enumerate(ranked) if r]
            if not picks:
                break
            for view, (_, guess, i) in picks:  # what one view is sure of teaches the other
                other = 1 - view
                sets[other] = [np.vstack([sets[other][0], pool[i][other]]), np.append(sets[other][1], guess)]
            used = {g[2] for _, g in picks}
            pool = [u for i, u in enumerate(pool) if i not in used]
            pool += [queue.pop(0) for _ in range(min(len(used), len(queue)))]
        self.sets_ = sets
        return self

    def predict(self, mv) -> DataFrame:
        shared, ks = mv.df.sparkSession.sparkContext.broadcast(self.sets_), self.ks

        def run(xs):
            total = np.zeros(len(xs[0]))
            for q, (x, y), k in zip(xs, shared.value, ks, strict=True):
                for a in range(0, len(q), 256):
                    total[a : a + 256] += self._knn(x, y, q[a : a + 256], min(k, len(y)))[0] / 2
            return pa.array(total)

        return map_views(mv, "prediction", T.DoubleType(), run)

    def fit_predict(self, mv):
        return self.fit(mv).predict(mv)
