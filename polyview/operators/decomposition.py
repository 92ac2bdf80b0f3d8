"""Joint and individual variation, group PCA and independent components over views."""

from __future__ import annotations

import math
import warnings
from dataclasses import replace
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from ..frame import MultiviewFrame
from ..functions import exprs as X
from ..functions.linalg import as_list, blocks, eigh, fix_signs, profile_elbows, svd_from_gram
from ..plans.gram import gram, summed
from .compose import _pca


class GroupPCA:
    """PCA of the views side by side, each first reduced by its own PCA; views map to shared components by least squares."""

    def __init__(self, n_components=None, n_individual_components="auto", multiview_output=True, prewhiten=False, whiten=False):
        self.n_components, self.n_individual_components = n_components, n_individual_components
        self.multiview_output, self.prewhiten, self.whiten = multiview_output, prewhiten, whiten

    def fit(self, mv):
        mv = mv.checked()
        g = gram(mv)
        self.means_, self.dims_, self.n_samples_ = g.means, g.dims, g.n
        own = self.n_individual_components
        own = [None if own == "auto" and self.n_components is None else o for o in as_list(self.n_components if own == "auto" else own, len(g.dims))]
        maps = []
        for i, k in enumerate(own):
            s, v = _pca(g.block(i, i), None if k is None else min(k, g.dims[i]))
            maps.append(v / (s / math.sqrt(g.n - 1)) if self.prewhiten else v)
        at = blocks([m.shape[1] for m in maps])
        t = np.zeros((sum(g.dims), at[-1].stop))
        for m, rows, cols in zip(maps, g.at, at, strict=True):
            t[rows, cols] = m
        s, v = _pca(t.T @ g.scatter @ t, self.n_components)
        self.explained_variance_ = s**2 / (g.n - 1)
        scale = np.sqrt(self.explained_variance_) if self.whiten else np.ones_like(s)
        self.components_ = t @ v / scale  # shared scores = sum of (x - mean) components
        cross = self.components_.T @ g.scatter  # S'X
        inner = np.linalg.pinv(self.components_.T @ g.scatter @ self.components_)
        self.individual_mixing_ = [(inner @ cross[:, r]).T for r in g.at]  # x - mean is about mixing s
        self.individual_components_ = [np.linalg.pinv(m).T for m in self.individual_mixing_]
        self.at_ = g.at
        return self

    def transform(self, mv, index=None):
        ids = list(range(len(self.means_))) if index is None else list(np.atleast_1d(index))
        if len(ids) != len(mv.views):
            raise ValueError("views and indexes differ in number")
        if self.multiview_output or index is not None:
            each = [X.project(v, self.individual_components_[i], self.means_[i]) for v, i in zip(mv.cols(), ids, strict=True)]
            if self.multiview_output:
                return mv.with_views(each)
            return mv.with_views([_mean(each)])
        parts = [X.project(v, self.components_[r], m) for v, r, m in zip(mv.cols(), self.at_, self.means_, strict=True)]
        return mv.with_views([F.transform(_mean(parts), lambda x: x * len(parts))])

    def fit_transform(self, mv):
        return self.fit(mv).transform(mv)

    def inverse_transform(self, scores, index=None):
        ids = list(range(len(self.means_))) if index is None else list(np.atleast_1d(index))
        cols = scores.cols() if self.multiview_output else scores.cols() * len(ids)
        return scores.with_views([F.zip_with(X.project(s, self.individual_mixing_[i].T), X.vector(self.means_[i]), lambda a, b: a + b) for s, i in zip(cols, ids, strict=True)])


def _mean(cols):
    out = cols[0]
    for c in cols[1:]:
        out = F.zip_with(out, c, lambda a, b: a + b)
    return F.transform(out, lambda x: x / len(cols))


def _orthonormal(w):
    vals, vecs = np.linalg.eigh(w @ w.T)
    return vecs / np.sqrt(vals) @ vecs.T @ w


def fastica(mv, k: int, max_iter: int = 200, tol: float = 1e-6, seed: int = 0) -> np.ndarray:
    """Symmetric FastICA (log-cosh) on one white view: each iteration is one pass that sums k x k moments."""
    if mv.local is None:
        with mv.pinned() as held:
            return fastica(held, k, max_iter, tol, seed)
    w = _orthonormal(np.random.default_rng(seed).standard_normal((k, k)))
    for _ in range(max_iter):
        def part(x, w=w):
            g = np.tanh(x @ w.T)
            return [g.T @ x, (1 - g * g).sum(axis=0), np.array([float(len(x))])]
        gx, dg, n = summed(mv, part)
        new = _orthonormal((gx - dg[:, None] * w) / n[0])
        done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < tol
        w = new
        if done:
            break
    else:
        warnings.warn("FastICA has not converged", stacklevel=2)
    return w


class GroupICA:
    """Independent components of a white group PCA; views are unmixed and mixed by least squares."""

    def __init__(self, n_components=None, n_individual_components="auto", multiview_output=True, prewhiten=False, max_iter=200, tol=1e-6, random_state=0):
        self.n_components, self.n_individual_components, self.multiview_output, self.prewhiten = n_components, n_individual_components, multiview_output, prewhiten
        self.max_iter, self.tol, self.random_state = max_iter, tol, random_state

    def fit(self, mv):
        pca = GroupPCA(self.n_components, self.n_individual_components, False, self.prewhiten, True).fit(mv)
        white = pca.transform(mv)
        k = pca.components_.shape[1]
        white = white.with_views(white.cols(), [k])
        w = fastica(white, k, self.max_iter, self.tol, self.random_state)
        self.pca_, self.unmixing_, self.means_ = pca, w, pca.means_
        self.components_ = pca.components_ @ w.T
        self.individual_mixing_ = [m @ np.linalg.inv(w) for m in pca.individual_mixing_]
        self.individual_components_ = [np.linalg.pinv(m).T for m in self.individual_mixing_]
        self.at_ = pca.at_
        return self

    transform, fit_transform, inverse_transform = GroupPCA.transform, GroupPCA.fit_transform, GroupPCA.inverse_transform


class MultiviewICA:
    """Shared independent sources, one unmixing per view: maximum likelihood by quasi-Newton steps (Richard et al. 2020).

    Views are reduced to ``n_components`` by PCA and whitened; each sweep is one pass that sums k x k moments
    of every view.  A step that lowers the likelihood too little is halved.  ``init`` is 'permica' (an ICA of
    each view, matched to the first), 'groupica', or a list of k x k unmixing matrices of the white views.
    """

    def __init__(self, n_components=None, noise=1.0, max_iter=200, tol=1e-3, multiview_output=True, random_state=0, init_iter=40, init="permica"):
        if isinstance(init, str) and init not in ("permica", "groupica"):
            raise ValueError("init must be permica, groupica or matrices")
        self.init = init
        self.n_components, self.noise, self.max_iter, self.tol, self.multiview_output, self.random_state = n_components, noise, max_iter, tol, multiview_output, random_state
        self.init_iter = init_iter

    def fit(self, mv):
        mv = mv.checked(multiview=True)
        g = gram(mv)
        k = self.n_components or min(g.dims)
        maps = []
        for i in range(len(g.dims)):
            s, v = _pca(g.block(i, i), k)
            maps.append(v / (s / math.sqrt(g.n)))
        white = mv.with_views([X.project(x, m, mean) for x, m, mean in zip(mv.cols(), maps, g.means, strict=True)], [k] * len(maps))
        with white.pinned() as held:
            ws = self._maximise(held, self._start(mv, held, maps, k), k)
        self.means_ = g.means
        self.individual_components_ = [m @ w.T for m, w in zip(maps, ws, strict=True)]
        self.individual_mixing_ = [np.linalg.pinv(c).T for c in self.individual_components_]
        return self

    def _start(self, mv, white, maps, k):
        if not isinstance(self.init, str):
            ws = [np.asarray(w, float) for w in self.init]
            if len(ws) != len(maps) or any(w.shape != (k, k) for w in ws):
                raise ValueError("init must hold a square matrix of n_components for each view")
            return ws
        if self.init == "groupica":
            own = GroupICA(k, max_iter=self.init_iter, random_state=self.random_state).fit(mv).individual_components_
            return [np.linalg.lstsq(m, c, rcond=None)[0].T for m, c in zip(maps, own, strict=True)]
        # start: ICA of the first view, others matched to it through their cross moments
        own = [fastica(type(mv)(white.df, white.key, (v,), None, (k,), None if white.local is None else white.local[:, i * k : (i + 1) * k]), k, self.init_iter, seed=self.random_state) for i, v in enumerate(white.views)]
        cross = gram(white)
        ws = [own[0]]
        for i in range(1, len(own)):
            c = own[0] @ cross.block(0, i) @ own[i].T / cross.n
            order = _assign(-np.abs(c))
            ws.append(np.sign(c[np.arange(k), order])[:, None] * own[i][order])
        return ws

    def _maximise(self, white, ws, k):
        n_views, noise = len(ws), self.noise

        def moments(ws):
            def part(x):
                ys = [x[:, i * k : (i + 1) * k] @ w.T for i, w in enumerate(ws)]
                mean = sum(ys) / n_views
                loss = (np.logaddexp(mean, -mean)).sum() + sum(((y - mean) ** 2).sum() for y in ys) / (2 * noise)
                psi, dpsi = np.tanh(mean), 1 - np.tanh(mean) ** 2
                out = [np.array([float(len(x)), loss])]
                for y in ys:
                    score = psi / n_views + (y - mean) / noise
                    curve = dpsi / n_views**2 + (1 - 1 / n_views) / noise
                    out += [score.T @ y, curve.T @ (y * y)]
                return out

            sums = summed(white, part)
            n, loss = sums[0]
            return loss / n - sum(np.linalg.slogdet(w)[1] for w in ws), [a / n for a in sums[1::2]], [a / n for a in sums[2::2]]

        loss, grads, curves = moments(ws)
        for _ in range(self.max_iter):
            if max(np.abs(a - np.eye(k)).max() for a in grads) < self.tol:
                break
            moves = []
            for a, h in zip(grads, curves, strict=True):
                gap, det = a - np.eye(k), h * h.T - 1
                det = np.where(np.abs(det) < 1e-3, 1e-3, det)
                step = -(h.T * gap - gap.T) / det
                bad = det < 0
                step = np.where(bad, -gap / np.maximum(h, 1e-3), step)
                step[np.arange(k), np.arange(k)] = -np.diag(gap) / (np.diag(h) + 1)
                moves.append(step)
            size = 1.0
            for _ in range(10):
                new = [w + size * m @ w for w, m in zip(ws, moves, strict=True)]
                found = moments(new)
                if found[0] < loss:
                    break
                size /= 2
            else:
                break
            ws, (loss, grads, curves) = new, found
        return ws

    def transform(self, mv, index=None):
        ids = list(range(len(self.means_))) if index is None else list(np.atleast_1d(index))
        each = [X.project(v, self.individual_components_[i], self.means_[i]) for v, i in zip(mv.cols(), ids, strict=True)]
        return mv.with_views(each if self.multiview_output else [_mean(each)])

    fit_transform, inverse_transform = GroupPCA.fit_transform, GroupPCA.inverse_transform

    def aggregate(self, sources):
        return sources.with_views([_mean(sources.cols())])


def _assign(cost: np.ndarray) -> np.ndarray:
    """Columns of least total cost, one per row (exact for few rows, else by auction)."""
    n = len(cost)
    if n <= 7:
        return np.array(min(permutations(range(n)), key=lambda p: cost[np.arange(n), list(p)].sum()))
    prices, owner, at, free = np.zeros(n), -np.ones(n, int), -np.ones(n, int), list(range(n))
    eps = 1e-4 * max(np.ptp(cost), 1e-12) / n
    while free:
        i = free.pop()
        value = -cost[i] - prices
        j, second = np.argsort(-value)[:2]
        prices[j] += value[j] - value[second] + eps
        if owner[j] >= 0:
            at[owner[j]] = -1
            free.append(int(owner[j]))
        owner[j], at[i] = i, j
    return at


class AJIVE:
    """Angle-based joint and individual variation: every step is algebra on the cross-Gram matrix; resampling runs on the driver."""

    def __init__(self, init_signal_ranks=None, joint_rank=None, individual_ranks=None, n_elbows=2, reconsider_joint_components=True, wedin_percentile=5, n_wedin_samples=1000, randdir_percentile=95, n_randdir_samples=1000, random_state=None):
        self.init_signal_ranks, self.joint_rank, self.individual_ranks, self.n_elbows = init_signal_ranks, joint_rank, individual_ranks, n_elbows
        self.reconsider_joint_components, self.wedin_percentile, self.n_wedin_samples = reconsider_joint_components, wedin_percentile, n_wedin_samples
        self.randdir_percentile, self.n_randdir_samples, self.random_state = randdir_percentile, n_randdir_samples, random_state

    def fit(self, mv):
        mv = mv.checked(multiview=True)
        g, rng = gram(mv), np.random.default_rng(self.random_state)
        n, v = g.n, len(g.dims)
        svds, ranks, cuts = [], [], []
        given = as_list(self.init_signal_ranks, v)
        for i in range(v):
            s, vec = svd_from_gram(g.block(i, i))
            r = given[i]
            if r is None:
                raw = svd_from_gram(g.raw[g.at[i], g.at[i]])[0]
                r = profile_elbows(raw[: math.ceil(math.log2(min(n, g.dims[i])))], self.n_elbows)[-1]
            if r >= len(s):
                warnings.warn("a signal rank is not below the full rank; one less is used", stacklevel=2)
                r = len(s) - 1
            svds.append((s, vec))
            ranks.append(r)
            cuts.append((s[r - 1] + s[r]) / 2)
        self.init_signal_ranks_, self.sv_thresholds_ = ranks, cuts
        at = blocks(ranks)
        bases = [vec[:, :r] / s[:r] for (s, vec), r in zip(svds, ranks, strict=True)]  # U_i = Xc bases_i
        stacked = np.zeros((sum(g.dims), sum(ranks)))
        for b, rows, cols in zip(bases, g.at, at, strict=True):
            stacked[rows, cols] = b
        vals, vecs = eigh(stacked.T @ g.scatter @ stacked)
        joint_all = stacked @ vecs / np.sqrt(np.maximum(vals, 1e-300))  # joint scores = [Xc] joint_all
        if self.joint_rank is None:
            wedin = np.percentile(self._wedin(svds, ranks, g, rng), self.wedin_percentile)
            rand = np.percentile(self._random_directions(n, ranks, rng), self.randdir_percentile)
            self.wedin_cutoff_, self.randdir_cutoff_ = wedin, rand
            k = int((vals > max(wedin, rand)).sum())
        else:
            k = min(self.joint_rank, len(vals))
        keep = list(range(k))
        if self.reconsider_joint_components:
            keep = [j for j in keep if all(np.linalg.norm(g.scatter[g.at[i]] @ joint_all[:, j]) >= cuts[i] for i in range(v))]
        self.joint_rank_ = len(keep)
        if not keep:
            warnings.warn("the joint rank is 0", RuntimeWarning, stacklevel=2)
        self.joint_map_ = joint_all[:, keep]
        self.joint_singular_values_ = np.sqrt(vals[keep])
        self.means_, self.at_, self.dims_ = g.means, g.at, g.dims
        self.joint_loadings_ = [g.scatter[r] @ self.joint_map_ for r in g.at]  # X'U
        self.individual_ranks_, self.individual_maps_ = [], []
        wanted = as_list(self.individual_ranks, v)
        for i, r in enumerate(g.at):
            rest = g.block(i, i) - self.joint_loadings_[i] @ self.joint_loadings_[i].T
            s, vec = svd_from_gram(rest, cut=1e-6)
            q = int((s > cuts[i]).sum()) if wanted[i] is None else min(wanted[i], len(s))
            self.individual_ranks_.append(q)
            self.individual_maps_.append(vec[:, :q])
        return self

    @staticmethod
    def _random_bases(n, ranks, rng):
        """Gram matrix of random orthonormal bases of R^n, side by side, drawn through a Wishart matrix."""
        w = _wishart(n, sum(ranks), rng)
        out, at = np.zeros_like(w), blocks(ranks)
        inv = [np.linalg.inv(np.linalg.cholesky(w[s, s])) for s in at]
        for a, x in zip(at, inv, strict=True):
            for b, y in zip(at, inv, strict=True):
                out[a, b] = x @ w[a, b] @ y.T
        return out

    def _random_directions(self, n, ranks, rng):
        return [np.linalg.eigvalsh(self._random_bases(n, ranks, rng))[-1] for _ in range(self.n_randdir_samples)]

    def _wedin(self, svds, ranks, g, rng):
        """Draws of V minus the sum of squared perturbation bounds of the views."""
        total = np.zeros(self.n_wedin_samples)
        for (s, vec), r, d in zip(svds, ranks, g.dims, strict=True):
            rest = s[r:]
            norms = np.zeros((2, self.n_wedin_samples))
            for j in range(self.n_wedin_samples):
                for side, size in ((0, d), (1, g.n)):
                    if not len(rest) or size <= r:
                        continue
                    x = rng.standard_normal((len(rest), r))
                    gap = x.T @ x + (_wishart(size - r - len(rest), r, rng) if size - r - len(rest) > 0 else 0)
                    norms[side, j] = np.linalg.norm(np.linalg.solve(np.linalg.cholesky(gap + 1e-12 * np.eye(r)), (rest[:, None] * x).T), 2)
            total += np.minimum(norms.max(axis=0) / s[r - 1], 1) ** 2
        return len(ranks) - total

    def scores(self, mv):
        """Shared joint scores U of the fitted rows, as an expression."""
        parts = [X.project(x, self.joint_map_[r], m) for x, r, m in zip(mv.cols(), self.at_, self.means_, strict=True)]
        return F.transform(_mean(parts), lambda x: x * len(parts))

    def transform(self, mv):
        """Joint parts of the views, U U' (X - mean)."""
        u = self.scores(mv)
        if not self.joint_rank_:
            return mv.with_views([F.transform(x, lambda e: e * 0.0) for x in mv.cols()], self.dims_)
        return mv.with_views([X.project(u, loading.T) for loading in self.joint_loadings_], self.dims_)

    def individual(self, mv):
        """Individual parts of the views."""
        out = []
        for x, joint, m, vec in zip(mv.cols(), self.transform(mv).views, self.means_, self.individual_maps_, strict=True):
            i = int(joint[1:])
            u = self.scores(mv)
            part = X.project(u, self.joint_loadings_[i].T) if self.joint_rank_ else F.transform(x, lambda e: e * 0.0)
            rest = F.zip_with(X.subtract(x, X.vector(m)), part, lambda a, b: a - b)
            out.append(X.project(rest, vec @ vec.T))
        return mv.with_views(out, self.dims_)

    def fit_transform(self, mv):
        return self.fit(mv).transform(mv)

    def inverse_transform(self, joint: MultiviewFrame, individual: MultiviewFrame) -> MultiviewFrame:
        """Joint and individual parts back to views: their sum and the mean; the frames share the key."""
        names = [f"i{v}" for v in individual.views]
        both = joint.df.join(individual.df.select(joint.key, *[F.col(v).alias(n) for v, n in zip(individual.views, names, strict=True)]), joint.key)
        add = lambda a, b: a + b
        views = [F.zip_with(F.zip_with(v, n, add), X.vector(m), add) for v, n, m in zip(joint.cols(), names, self.means_, strict=True)]
        return replace(joint, df=both).with_views(views, self.dims_)


def _wishart(n, d, rng):
    """A draw of G'G for Gaussian G (n x d)."""
    if n < d:
        x = rng.standard_normal((n, d))
        return x.T @ x
    a = np.tril(rng.standard_normal((d, d)), -1)
    a[np.arange(d), np.arange(d)] = np.sqrt(rng.chisquare(n - np.arange(d)))
    return a @ a.T


__all__ = ["AJIVE", "GroupICA", "GroupPCA", "MultiviewICA", "fastica", "fix_signs"]
