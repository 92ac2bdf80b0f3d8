"""Linear and kernel correlation embeddings, generalised CCA and multi-view scaling."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import MultiviewFrame
from ..functions import exprs as X
from ..functions.linalg import as_list, blocks, chi2_sf, eigh, f_sf, fix_signs, n_components, profile_elbows, svd_from_gram
from ..plans.gram import Gram, gram, merged, summed


def shrinkage(g: Gram, view: int, reg, fourth: float | None = None) -> np.ndarray:
    """The view's scatter, regularised: a share in [0, 1] of the identity, or Ledoit-Wolf ('lw') or OAS ('oas') times n."""
    c, d = g.block(view, view), g.dims[view]
    if reg is None:
        return c
    if isinstance(reg, str):
        s, n = c / g.n, g.n
        mu, t2 = np.trace(s) / d, (s * s).sum()
        if reg == "oas":
            alpha = t2 / d**2
            num, den = alpha + mu**2, (n + 1) * (alpha - mu**2 / d)
            share = 1.0 if den == 0 else min(num / den, 1.0)
        elif reg == "lw":
            delta = (t2 - d * mu**2) / d
            share = min((fourth / n - t2) / (d * n), delta) / delta if delta else 0.0
        else:
            raise ValueError("regs must be None, numbers in [0, 1], 'lw' or 'oas'")
        return n * ((1 - share) * s + share * mu * np.eye(d))
    if not 0 <= reg <= 1:
        raise ValueError("regs must be None, numbers in [0, 1], 'lw' or 'oas'")
    return (1 - reg) * c + reg * np.eye(d)


def common_signs(mv: MultiviewFrame, matrices_: list[np.ndarray], means) -> np.ndarray:
    """+1 or -1 per component, so that the common score of largest size is positive (the least key wins ties)."""
    k = matrices_[0].shape[1]
    parts = [X.project(v, m, mean) for v, m, mean in zip(mv.cols(), matrices_, means, strict=True)]
    one = lambda i: sum(p[i] for p in parts[1:]) + parts[0][i]
    row = mv.df.select(mv.key, *[one(i).alias(f"c{i}") for i in range(k)]).agg(*[F.max_by(f"c{i}", F.struct(F.abs(f"c{i}"), -F.col(mv.key))).alias(f"c{i}") for i in range(k)]).first()
    return np.array([-1.0 if row[i] is not None and row[i] < 0 else 1.0 for i in range(k)])


class MCCA:
    """Multi-set canonical correlation (sum of correlations) by one generalised eigenproblem in feature space.

    With ``signal_ranks`` each view is first reduced by its SVD; ``i_mcca_method`` 'svd' takes the flag
    mean of the bases, 'gevp' solves the reduced problem ('auto': 'svd' without regs, else 'gevp').
    """

    n_views_: int | None = None

    def __init__(self, n_components=1, regs=None, signal_ranks=None, center=True, i_mcca_method="auto", multiview_output=True):
        self.n_components, self.regs, self.signal_ranks, self.center = n_components, regs, signal_ranks, center
        self.i_mcca_method, self.multiview_output = i_mcca_method, multiview_output

    def fit(self, mv: MultiviewFrame):
        return self._fit(mv.checked(multiview=True, enforce_views=self.n_views_))

    def _fit(self, mv: MultiviewFrame):
        g = gram(mv)
        if not self.center:
            g = Gram(g.n, np.zeros_like(g.mean), g.raw, g.dims, g.fourth)
        regs = as_list(self.regs, len(g.dims))
        fourth = [None] * len(g.dims)
        if "lw" in regs:
            m = np.concatenate(g.means)
            sums = summed(mv, lambda x: [np.array([(((x - m)[:, s] ** 2).sum(axis=1) ** 2).sum() for s in g.at])])
            fourth = list(sums[0])
        bases = [np.eye(d) for d in g.dims]
        if self.signal_ranks is not None:
            bases = [svd_from_gram(g.block(i, i), r)[1] for i, r in enumerate(as_list(self.signal_ranks, len(g.dims)))]
        widths = [b.shape[1] for b in bases]
        k, at = n_components(self.n_components, widths), blocks(widths)
        method = self.i_mcca_method
        flag = self.signal_ranks is not None and (method == "svd" or method == "auto" and self.regs is None)
        left, right = np.zeros((sum(widths),) * 2), np.zeros((sum(widths),) * 2)
        for a in range(len(widths)):
            for b in range(len(widths)):
                left[at[a], at[b]] = bases[a].T @ g.block(a, b) @ bases[b]
            right[at[a], at[a]] = left[at[a], at[a]] = bases[a].T @ shrinkage(g, a, None if flag else regs[a], fourth[a]) @ bases[a]
        self.evals_, w = eigh(left, right, k)
        self.loadings_ = [b @ w[s] for b, s in zip(bases, at, strict=True)]
        self.means_, self.dims_, self.n_samples_ = g.means, g.dims, g.n
        stacked = np.vstack(self.loadings_)
        self.common_score_norms_ = np.sqrt(np.maximum(np.diag(stacked.T @ g.scatter @ stacked), 1e-300))
        signs = common_signs(mv, self.loadings_, self.means_)
        self.loadings_ = [m * signs for m in self.loadings_]
        return self

    @property
    def n_components_(self):
        return self.loadings_[0].shape[1]

    def score_columns(self, mv):
        return [X.project(v, m, mean) for v, m, mean in zip(mv.cols(), self.loadings_, self.means_, strict=True)]

    def transform(self, mv: MultiviewFrame):
        """A frame of view scores, or with ``multiview_output`` false a table of common scores."""
        if len(mv.views) != len(self.loadings_):
            raise ValueError(f"expected {len(self.loadings_)} views, got {len(mv.views)}")
        scores = self.score_columns(mv)
        if self.multiview_output:
            return mv.with_views(scores, [self.n_components_] * len(scores))
        out = scores[0]
        for s in scores[1:]:
            out = F.zip_with(out, s, lambda a, b: a + b)
        return mv.df.select(*mv.keep(), F.zip_with(out, X.vector(self.common_score_norms_), lambda a, n: a / n).alias("common"))

    def fit_transform(self, mv):
        return self.fit(mv).transform(mv)

    def transform_view(self, mv: MultiviewFrame, view: int) -> MultiviewFrame:
        """Scores of a frame that has view number ``view`` only."""
        return mv.with_views([X.project(mv.cols()[0], self.loadings_[view], self.means_[view])], [self.n_components_])

    def inverse_transform_view(self, scores: MultiviewFrame, view: int) -> MultiviewFrame:
        """View number ``view`` from its scores."""
        return scores.with_views([F.zip_with(X.project(scores.cols()[0], self.loadings_[view].T), X.vector(self.means_[view]), lambda a, b: a + b)], [self.dims_[view]])

    def score_view(self, mv: MultiviewFrame, view: int) -> float:
        """Sum of squared reconstruction errors of a frame that has view number ``view`` only."""
        back = self.inverse_transform_view(self.transform_view(mv, view), view).df.select(mv.key, F.col("v0").alias("back"))
        return mv.df.join(back, mv.key).agg(F.sum(X.sqdist(mv.cols()[0], F.col("back")))).first()[0]

    def inverse_transform(self, scores: MultiviewFrame):
        back = [F.zip_with(X.project(s, m.T), X.vector(mean), lambda a, b: a + b) for s, m, mean in zip(scores.cols(), self.loadings_, self.means_, strict=True)]
        return scores.with_views(back, self.dims_)

    def score(self, mv) -> list[float]:
        """Sum of squared reconstruction errors of each view."""
        errors = []
        for v, m, mean in zip(mv.cols(), self.loadings_, self.means_, strict=True):
            back = F.zip_with(X.project(X.project(v, m, mean), m.T), X.vector(mean), lambda a, b: a + b)
            errors.append(F.sum(X.sqdist(v, back)))
        return list(mv.df.agg(*errors).first())

    def canon_corrs(self, scores: MultiviewFrame) -> np.ndarray:
        """Correlations of view scores by component: (k,) for two views, else (k, V, V)."""
        v, k = len(scores.views), self.n_components_
        pairs = [(i, a, b) for i in range(k) for a in range(v) for b in range(a + 1, v)]
        row = scores.df.agg(*[F.corr(F.col(scores.views[a])[i], F.col(scores.views[b])[i]) for i, a, b in pairs]).first()
        out = np.tile(np.eye(v), (k, 1, 1))
        for (i, a, b), r in zip(pairs, row, strict=True):
            out[i, a, b] = out[i, b, a] = r
        return out[:, 0, 1] if v == 2 else out


def cca_stats(r: np.ndarray, n: int, p: int, q: int) -> dict[str, np.ndarray]:
    """Tests of canonical correlations r: Wilks' lambda, Rao's F and the Bartlett-Lawley chi-squared, with tails."""
    r = np.minimum(np.asarray(r, float), 1.0)
    r = np.where(r > 1 - 1e-9, 1.0, r)
    k = np.arange(len(r))
    d1, d2 = p - k, q - k
    free = 1 - r**2
    wilks = np.cumprod(free[::-1])[::-1]
    df1 = d1 * d2
    den = d1**2 + d2**2 - 5
    s = np.sqrt(np.where((df1**2 > 4) & (den > 0), np.maximum(df1**2 - 4, 0) / np.where(den == 0, 1, den), 1.0))
    df2 = (n - 1 - 0.5 * (p + q + 1)) * s - 0.5 * df1 + 1
    with np.errstate(divide="ignore", invalid="ignore"):
        root = wilks ** (1 / s)
        f = np.where(wilks > 0, (1 - root) / root * df2 / df1, np.inf)
        inner = np.concatenate([[0.0], np.cumsum(1 / r[:-1] ** 2)])
        chisq = np.where(wilks > 0, -(n - k - 0.5 * (p + q + 3) + inner) * np.log(np.where(wilks > 0, wilks, 1)), np.inf)
    pf = np.array([f_sf(a, b, c) for a, b, c in zip(f, df1, df2, strict=True)])
    pchi = np.array([chi2_sf(a, b) for a, b in zip(chisq, df1, strict=True)])
    return {"r": r, "Wilks": wilks, "df1": df1, "df2": df2, "F": f, "pF": pf, "chisq": chisq, "pChisq": pchi}


class CCA(MCCA):
    """Canonical correlation of exactly two views."""

    n_views_ = 2

    def fit(self, mv):
        mv = mv.checked(enforce_views=2)
        if not isinstance(self.n_components, int) or not 1 <= self.n_components <= min(mv.dims):
            raise ValueError("n_components must be an integer from 1 to the smaller width")
        return self._fit(mv)

    def stats(self, scores: MultiviewFrame, stat: str | None = None):
        out = cca_stats(np.abs(self.canon_corrs(scores)), scores.df.count(), *self.dims_)
        return out if stat is None else out[stat]


class GCCA:
    """Generalised CCA: rows are z-scored over their features; views are cut to a rank; the shared space comes from their bases."""

    def __init__(self, n_components=None, fraction_var=None, sv_tolerance=None, n_elbows=2, max_rank=False):
        self.n_components, self.fraction_var, self.sv_tolerance, self.n_elbows, self.max_rank = n_components, fraction_var, sv_tolerance, n_elbows, max_rank

    @staticmethod
    def row_scaled(mv: MultiviewFrame) -> MultiviewFrame:
        """Each row minus its mean over its deviation (n - 1); a constant row becomes zeros."""
        out = []
        for v in mv.cols():
            centred = X.let(F.struct(v.alias("v"), (X.total(v) / F.size(v)).alias("m")), lambda s: F.transform(s.v, lambda x: x - s.m))
            out.append(X.let(centred, lambda c: X.let(F.struct(c.alias("c"), F.sqrt(X.dot(c, c) / (F.size(c) - 1)).alias("dev")), lambda s: F.transform(s.c, lambda x: F.when(s.dev > 0, x / s.dev).otherwise(0.0)))))
        return mv.with_views(out, mv.dims)

    def _rank(self, svals, n, d):
        if self.sv_tolerance:
            return int((svals > self.sv_tolerance).sum())
        if self.n_components:
            if self.n_components > min(n, d):
                raise ValueError("n_components is more than samples or features")
            return self.n_components
        if self.fraction_var:
            return 1 + int((np.cumsum(svals**2) / (svals**2).sum() < self.fraction_var).sum())
        top = svals[: math.ceil(math.log2(min(n, d)))]
        return profile_elbows(top, self.n_elbows)[-1]

    def fit(self, mv: MultiviewFrame):
        return self.partial_fit(mv, reset=True)

    def partial_fit(self, mv: MultiviewFrame, reset: bool = False, multiview_step: bool = True):
        """Take in more rows: Gram matrices add up, so the result is that of all rows at once. Without ``multiview_step`` rows are only taken in."""
        mv = mv.checked()
        if len(mv.views) < 2:
            warnings.warn("fewer than two views", stacklevel=2)
        g = self.gram_ = merged(None if reset else getattr(self, "gram_", None), gram(self.row_scaled(mv)))
        if not multiview_step:
            return self
        parts = []
        for i, d in enumerate(g.dims):
            s, v = svd_from_gram(g.block(i, i))
            r = min(self._rank(s, g.n, min(g.dims)), len(s))
            parts.append((s[:r], v[:, :r]))
        self.ranks_ = [len(s) for s, _ in parts]
        at = blocks(self.ranks_)
        joint = np.eye(sum(self.ranks_))
        for a, (sa, va) in enumerate(parts):
            for b, (sb, vb) in enumerate(parts):
                if a != b:
                    joint[at[a], at[b]] = (va.T @ g.block(a, b) @ vb) / np.outer(sa, sb)
        k = max(self.ranks_) if self.max_rank else min(self.ranks_)
        _, w = eigh(joint, rank=k)
        self.projections_, self.means_ = [], g.means
        for (s, v), p in zip(parts, at, strict=True):
            x = w[p] / np.maximum(np.linalg.norm(w[p], axis=0), 1e-300)
            self.projections_.append(math.sqrt(max(len(parts) - 1, 1)) * (v / s) @ x)
        return self

    def transform(self, mv, view_idx=None):
        ids = list(range(len(self.projections_))) if view_idx is None else list(np.atleast_1d(view_idx))
        if len(mv.views) != len(ids):
            raise ValueError("views and indexes differ in number")
        scaled = self.row_scaled(mv)
        return scaled.with_views([X.project(v, self.projections_[i], self.means_[i]) for v, i in zip(scaled.cols(), ids, strict=True)])

    def fit_transform(self, mv):
        return self.fit(mv).transform(mv)


def select_dimension(x, n_components=None, n_elbows=2, threshold=None):
    """Elbows of a list of values, or of the leading singular values of a one-view frame."""
    if isinstance(x, MultiviewFrame):
        g = gram(x)
        svals = svd_from_gram(g.raw)[0]
        x = svals[: n_components or math.ceil(math.log2(min(g.n, g.dims[0])))]
    out = profile_elbows(x, n_elbows, threshold)
    return out, [float(np.sort(np.asarray(x, float))[::-1][i - 1]) for i in out]


#: Precomputed distances are n x n; more rows than this is an error, not a sample.
MAX_DISTANCE_ROWS = 5000


class MVMDS:
    """Multi-view scaling by stepwise common components of the doubly centred squared distances.

    For Euclidean views the matrix of view i is Xc Xc', so every iterate is H a with H the views side by
    side; the whole iteration runs on the coefficients a.  ``fit_transform`` gives coordinates of the
    rows it was fitted on.  With dissimilarity 'precomputed' a view is a square matrix of distances, its
    columns in the order of the key; these n x n matrices go to the driver, at most MAX_DISTANCE_ROWS rows.
    """

    def __init__(self, n_components=2, num_iter=15, dissimilarity="euclidean"):
        if dissimilarity not in ("euclidean", "precomputed"):
            raise ValueError("dissimilarity must be euclidean or precomputed")
        self.n_components, self.num_iter, self.dissimilarity = n_components, num_iter, dissimilarity

    def _fit_distances(self, mv) -> DataFrame:
        mv = mv.checked(multiview=True)
        n = mv.df.count()
        if n > MAX_DISTANCE_ROWS or any(d != n for d in mv.dims):
            raise ValueError(f"views must be square matrices of at most {MAX_DISTANCE_ROWS} rows")
        rows = mv.df.select(*mv.keep(), *mv.views).orderBy(mv.key).toArrow()
        centre = np.eye(n) - 1 / n
        bs = [-0.5 * centre @ (rows[v].combine_chunks().flatten().to_numpy().reshape(n, n) ** 2) @ centre for v in mv.views]
        _, starts = eigh(sum(bs), rank=min(self.n_components, n))
        done = np.zeros((n, 0))
        for q in starts.T:
            weights = lambda x: [max(float(x @ b @ x), 1e-4) for b in bs]
            mu = weights(q)
            for _ in range(self.num_iter):
                q = sum(b @ q * (n / m) for b, m in zip(bs, mu, strict=True))
                q = q - done @ (done.T @ q)
                q = q / max(np.linalg.norm(q), 1e-300)
                mu = weights(q)
            done = np.column_stack([done, q])
        self.embedding_ = fix_signs(done)
        out = rows.select(mv.keep()).append_column("mds", pa.array(self.embedding_.tolist(), pa.list_(pa.float64())))
        return mv.df.sparkSession.createDataFrame(out)

    def fit(self, mv):
        mv = mv.checked(multiview=True)
        g = gram(mv)
        c, k = g.scatter, self.n_components
        if k > g.n:
            warnings.warn("n_components is more than the samples", stacklevel=2)
            k = g.n
        vals, vecs = eigh(c)
        keep = vals > 1e-9 * vals[0]
        starts = (vecs / np.sqrt(np.where(keep, vals, 1)))[:, keep][:, :k]  # H a has norm one
        done = np.zeros((len(c), 0))
        for j in range(starts.shape[1]):
            a = starts[:, j]
            def weights(x):
                return [max(float(x @ c[:, s] @ c[s, :] @ x), 1e-4) for s in g.at]
            mu = weights(a)
            for _ in range(self.num_iter):
                new = np.zeros_like(a)
                for s, m in zip(g.at, mu, strict=True):
                    new[s] += c[s] @ a * (g.n / m)
                new -= done @ (done.T @ c @ new)
                a = new / math.sqrt(max(new @ c @ new, 1e-300))
                mu = weights(a)
            done = np.column_stack([done, a])
        self.coefficients_, self.means_ = fix_signs(done), g.means
        self.at_ = g.at
        return self

    def fit_transform(self, mv) -> DataFrame:
        if self.dissimilarity == "precomputed":
            return self._fit_distances(mv)
        self.fit(mv)
        parts = [X.project(v, self.coefficients_[s], m) for v, s, m in zip(mv.cols(), self.at_, self.means_, strict=True)]
        out = parts[0]
        for p in parts[1:]:
            out = F.zip_with(out, p, lambda a, b: a + b)
        return mv.df.select(*mv.keep(), out.alias("mds"))


KERNELS = {
    "linear": lambda x, y, **_: x @ y.T,
    "poly": lambda x, y, gamma=None, coef0=1, degree=3: (x @ y.T * (1 / x.shape[1] if gamma is None else gamma) + coef0) ** degree,
    "rbf": lambda x, y, gamma=None: np.exp(-(1 / x.shape[1] if gamma is None else gamma) * np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)),
    "sigmoid": lambda x, y, gamma=None, coef0=1: np.tanh(x @ y.T * (1 / x.shape[1] if gamma is None else gamma) + coef0),
    "cosine": lambda x, y: (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T,
    "laplacian": lambda x, y, gamma=None: np.exp(-(1 / x.shape[1] if gamma is None else gamma) * np.abs(x[:, None] - y[None]).sum(-1)),
}


class KMCCA:
    """Kernel multi-set CCA by partial Gram-Schmidt orthogonalisation: each view's kernel is approximated by pivots.

    Pivots are found one at a time (the row of largest residual), until the residual trace is below
    ``tol`` of the whole; features are the row's kernel against the pivots, solved by the pivots'
    triangle.  The kernel matrix is never formed: a step is one pass over the rows, and memory holds
    pivots only.  With tol = 0 the features span the kernel's full rank (at most ``max_rank`` pivots; more is an error).
    """

    def __init__(self, n_components=1, kernel="linear", kernel_params=None, regs=None, diag_mode="A", center=True, tol=0.1, max_rank=500, multiview_output=True):
        self.n_components, self.kernel, self.kernel_params, self.regs, self.diag_mode = n_components, kernel, kernel_params, regs, diag_mode
        self.center, self.tol, self.max_rank, self.multiview_output = center, tol, max_rank, multiview_output

    def _kernel(self, view):
        k = as_list(self.kernel, self.n_views_)[view] if not callable(self.kernel) else self.kernel
        params = (self.kernel_params if isinstance(self.kernel_params, list) else [self.kernel_params or {}] * self.n_views_)[view]
        f = k if callable(k) else KERNELS[k]
        return lambda x, y: f(x, y, **params)

    def _pivots(self, mv, view):
        start = sum(mv.dims[:view])
        held = None if mv.local is None else mv.local[:, start : start + mv.dims[view]]
        one, kernel = MultiviewFrame(mv.df, mv.key, (mv.views[view],), None, (mv.dims[view],), held), self._kernel(view)
        pivots, low, first = np.zeros((0, mv.dims[view])), np.zeros((0, 0)), None

        def residuals(x):
            diag = np.array([kernel(r[None], r[None])[0, 0] for r in x])
            if len(pivots):
                diag = diag - (np.linalg.solve(low, kernel(pivots, x)) ** 2).sum(axis=0)
            i = int(diag.argmax())
            return [np.array([diag.sum()]), np.array([diag[i]]), x[i]]

        def better(a, b):
            top = a if a[1][0] >= b[1][0] else b
            return [a[0] + b[0], top[1], top[2]]

        while True:
            total, most, row = summed(one, residuals, better)
            first = total[0] if first is None else first
            if total[0] <= max(self.tol, 1e-9) * first or most[0] <= 1e-10 * max(first, 1e-300):
                return pivots, low
            if len(pivots) >= self.max_rank:
                raise ValueError(f"more than {self.max_rank} pivots are needed; raise tol or max_rank")
            cross = np.linalg.solve(low, kernel(pivots, row[None]))[:, 0] if len(pivots) else np.zeros(0)
            low = np.block([[low, np.zeros((len(low), 1))], [cross[None, :], np.array([[math.sqrt(most[0])]])]])
            pivots = np.vstack([pivots, row])

    def features(self, mv: MultiviewFrame) -> MultiviewFrame:
        """The rows in the span of the pivots, one Arrow batch at a time."""
        held = [(p, low, self._kernel(i)) for i, (p, low) in enumerate(self.pivots_)]
        keep, names = mv.keep(), [f"v{i}" for i in range(len(held))]
        n = len(keep)

        def run(batches):
            for b in batches:
                out = list(b.columns[:n])
                for c, (p, low, kernel) in zip(b.columns[n:], held, strict=True):
                    x = c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    f = np.linalg.solve(low, kernel(p, x)).T
                    out.append(pa.ListArray.from_arrays(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32), pa.array(f.ravel())))
                yield pa.RecordBatch.from_arrays(out, [*keep, *names])

        from pyspark.sql import types as T

        schema = T.StructType([mv.df.schema[k] for k in keep] + [T.StructField(v, T.ArrayType(T.DoubleType())) for v in names])
        df = mv.df.select(*keep, *mv.views).mapInArrow(run, schema)
        return MultiviewFrame(df, mv.key, tuple(names), mv.label, tuple(len(p) for p, _ in self.pivots_))

    def fit(self, mv):
        mv = mv.checked(multiview=True)
        if self.diag_mode not in ("A", "B", "C"):
            raise ValueError("diag_mode must be A, B or C")
        self.n_views_ = len(mv.views)
        with mv.pinned() as held:
            self.pivots_ = [self._pivots(held, i) for i in range(self.n_views_)]
        f = self.features(mv)
        g = gram(f)
        if not self.center:
            g = Gram(g.n, np.zeros_like(g.mean), g.raw, g.dims, g.fourth)
        regs = as_list(self.regs, self.n_views_)
        parts, widths = [], []
        for i, reg in enumerate(regs):
            s, v = svd_from_gram(g.block(i, i))
            k = s**2  # singular values of the kernel
            r = reg or 0.0
            if r == 0:
                t = k**2
            elif self.diag_mode == "A":
                t = (1 - r) * k**2 + r * k
            elif self.diag_mode == "B":
                t = k**2 if r > 1 - 1e-12 else (1 - r) * (k + g.n * r / (1 - r) / 2) ** 2
            else:
                t = (1 - r) * k**2 + r
            parts.append((s, v, k / np.sqrt(t)))
            widths.append(len(s))
        at = blocks(widths)
        joint = np.eye(sum(widths))
        for a, (sa, va, qa) in enumerate(parts):
            for b, (sb, vb, qb) in enumerate(parts):
                if a != b:
                    joint[at[a], at[b]] = (va.T @ g.block(a, b) @ vb) * np.outer(qa / sa, qb / sb)
        self.evals_, w = eigh(joint, rank=n_components(self.n_components, widths))
        self.loadings_ = [v * (q / s) @ w[p] for (s, v, q), p in zip(parts, at, strict=True)]
        self.means_ = g.means
        signs = common_signs(f, self.loadings_, self.means_)
        self.loadings_ = [m * signs for m in self.loadings_]
        stacked = np.vstack(self.loadings_)
        self.common_score_norms_ = np.sqrt(np.maximum(np.diag(stacked.T @ g.scatter @ stacked), 1e-300))
        return self

    n_components_ = MCCA.n_components_
    score_columns, canon_corrs = MCCA.score_columns, MCCA.canon_corrs

    def transform(self, mv):
        return MCCA.transform(self, self.features(mv))

    def fit_transform(self, mv):
        return self.fit(mv).transform(mv)
