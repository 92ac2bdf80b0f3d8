"""Deep CCA and split autoencoders: small networks in numpy, trained on the driver from a stream of batches."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import MultiviewFrame


class Net:
    """A multilayer perceptron: sigmoid (or relu) hidden layers and a linear output."""

    def __init__(self, sizes, rng, hidden="sigmoid"):
        self.w = [rng.standard_normal((a, b)) * np.sqrt(1 / a) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.hidden = hidden

    @property
    def params(self):
        return [*self.w, *self.b]

    def forward(self, x):
        self.acts = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            x = x @ w + b
            if i + 1 < len(self.w):
                x = 1 / (1 + np.exp(-np.clip(x, -60, 60))) if self.hidden == "sigmoid" else np.maximum(x, 0)
            self.acts.append(x)
        return x

    def backward(self, g):
        """Gradients of params and of the input, for the last forward pass."""
        gw, gb = [], []
        for i in range(len(self.w) - 1, -1, -1):
            gw.append(self.acts[i].T @ g)
            gb.append(g.sum(axis=0))
            g = g @ self.w[i].T
            if i:
                a = self.acts[i]
                g = g * (a * (1 - a) if self.hidden == "sigmoid" else a > 0)
        return [*gw[::-1], *gb[::-1]], g


def cca_loss(h1, h2, k=None, ridge=1e-3):
    """Minus the sum of the top k canonical correlations (all: minus the root of the sum of their squares), and its gradients (Andrew et al. 2013)."""
    n = len(h1)
    a, b = h1 - h1.mean(0), h2 - h2.mean(0)
    s11, s22, s12 = a.T @ a / (n - 1) + ridge * np.eye(a.shape[1]), b.T @ b / (n - 1) + ridge * np.eye(b.shape[1]), a.T @ b / (n - 1)

    def root(s):
        v, e = np.linalg.eigh(s)
        return e / np.sqrt(np.maximum(v, 1e-9)) @ e.T

    r1, r2 = root(s11), root(s22)
    u, d, vt = np.linalg.svd(r1 @ s12 @ r2, full_matrices=False)
    u, d, vt = u[:, :k], d[:k], vt[:k]
    value = float(d.sum() if k else np.sqrt((d * d).sum()))
    w = np.ones_like(d) if k else d / max(value, 1e-300)  # derivatives by the correlations
    d12 = r1 @ (u * w) @ vt @ r2
    d11, d22 = -0.5 * r1 @ (u * (w * d)) @ u.T @ r1, -0.5 * r2 @ (vt.T * (w * d)) @ vt @ r2
    g1 = (2 * a @ d11 + b @ d12.T) / (n - 1)
    g2 = (2 * b @ d22 + a @ d12) / (n - 1)
    return -value, -(g1 - g1.mean(0)), -(g2 - g2.mean(0))


@contextmanager
def _shuffled(mv: MultiviewFrame, seed: int):
    """The frame in the order of a hash of the key, sorted once for all epochs."""
    df = mv.df.orderBy(F.xxhash64(F.col(mv.key), F.lit(seed)), mv.key).select(*mv.keep(), *mv.views)
    with replace(mv, df=df).pinned() as out:
        yield out


def _batches(mv: MultiviewFrame, size: int):
    """Arrays of the views, ``size`` rows at a time; of a frame that isn't held here, the driver takes a partition at a time."""
    if mv.local is not None:
        for i in range(0, len(mv.local), size):
            yield np.split(mv.local[i : i + size], np.cumsum(mv.dims)[:-1], axis=1)
        return
    held = []
    for r in mv.df.select(*mv.views).toLocalIterator(prefetchPartitions=True):
        held.append(r)
        if len(held) == size:
            yield [np.array([x[v] for x in held]) for v in mv.views]
            held = []
    if held:
        yield [np.array([x[v] for x in held]) for v in mv.views]


def _map_nets(mv: MultiviewFrame, outputs) -> MultiviewFrame:
    """New views by ``outputs(list of arrays) -> list of arrays``, a map over Arrow batches."""
    keep = mv.keep()
    n, names = len(keep), None
    probe = outputs([np.zeros((1, d)) for d in mv.dims])
    names = [f"v{i}" for i in range(len(probe))]

    def run(batches):
        for b in batches:
            out = outputs([c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in b.columns[n:]])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *[pa.ListArray.from_arrays(np.arange(0, o.size + 1, o.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(o).ravel())) for o in out]], [*keep, *names])

    schema = T.StructType([mv.df.schema[c] for c in keep] + [T.StructField(v, T.ArrayType(T.DoubleType())) for v in names])
    return MultiviewFrame(mv.df.select(*keep, *mv.views).mapInArrow(run, schema), mv.key, tuple(names), mv.label, tuple(o.shape[1] for o in probe))


class DCCA:
    """Two networks trained on the CCA loss by RMSprop, then linear CCA of their outputs.

    Training stops when an epoch improves the mean loss by no more than ``tolerance``.
    """

    def __init__(self, n_components=2, layer_sizes1=None, layer_sizes2=None, use_all_singular_values=False, epoch_num=200, batch_size=800, learning_rate=1e-3, reg_par=1e-5, tolerance=1e-3, random_state=0):
        if n_components < 1 or epoch_num < 1 or batch_size < 2 or learning_rate <= 0 or reg_par < 0 or tolerance < 0:
            raise ValueError("a parameter is out of range")
        self.n_components, self.layer_sizes1, self.layer_sizes2, self.use_all = n_components, layer_sizes1, layer_sizes2, use_all_singular_values
        self.epoch_num, self.batch_size, self.learning_rate, self.reg_par, self.tolerance, self.random_state = epoch_num, batch_size, learning_rate, reg_par, tolerance, random_state

    def fit(self, mv):
        from .embed import CCA

        mv = mv.checked(enforce_views=2)
        rng = np.random.default_rng(self.random_state)
        sizes = [list(s or [128, self.n_components]) for s in (self.layer_sizes1, self.layer_sizes2)]
        if any(s[-1] != self.n_components for s in sizes):
            raise ValueError("the last layers must have n_components units")
        self.nets_ = [Net([d, *s], rng) for d, s in zip(mv.dims, sizes, strict=True)]
        cache = [[np.zeros_like(p) for p in net.params] for net in self.nets_]
        last = np.inf
        with _shuffled(mv, self.random_state) as rows:
            for _ in range(self.epoch_num):
                losses = []
                for xs in _batches(rows, self.batch_size):
                    if len(xs[0]) < 2:
                        continue
                    hs = [net.forward(x) for net, x in zip(self.nets_, xs, strict=True)]
                    loss, *gs = cca_loss(*hs, None if self.use_all else self.n_components)
                    losses.append(loss)
                    for net, g, held in zip(self.nets_, gs, cache, strict=True):
                        for p, d, c in zip(net.params, net.backward(g)[0], held, strict=True):
                            d = d + self.reg_par * p
                            c += 0.01 * (d * d - c)
                            p -= self.learning_rate * d / (np.sqrt(c) + 1e-8)
                now = float(np.mean(losses))
                if last - now <= self.tolerance:
                    break
                last = now
        self.loss_ = now
        self.cca_ = CCA(self.n_components, regs=1e-4).fit(self._outputs(mv))
        return self

    def _outputs(self, mv):
        mv = mv if mv.dims else mv.checked()
        return _map_nets(mv, lambda xs: [net.forward(x) for net, x in zip(self.nets_, xs, strict=True)])

    def transform(self, mv):
        return self.cca_.transform(self._outputs(mv))

    def fit_transform(self, mv):
        return self.fit(mv).transform(mv)


class SplitAE:
    """One encoder of view 1 and decoders to both views, trained by Adam on the summed squared error."""

    def __init__(self, hidden_size=64, num_hidden_layers=2, embed_size=20, training_epochs=10, batch_size=16, learning_rate=0.001, random_state=0):
        self.hidden_size, self.num_hidden_layers, self.embed_size = hidden_size, num_hidden_layers, embed_size
        self.training_epochs, self.batch_size, self.learning_rate, self.random_state = training_epochs, batch_size, learning_rate, random_state

    def fit(self, mv):
        mv = mv.checked(enforce_views=2)
        rng, mid = np.random.default_rng(self.random_state), [self.hidden_size] * self.num_hidden_layers
        enc = Net([mv.dims[0], *mid, self.embed_size], rng, "relu")
        decs = [Net([self.embed_size, *mid, d], rng, "relu") for d in mv.dims]
        nets = self.nets_ = [enc, *decs]
        first = [[np.zeros_like(p) for p in n.params] for n in nets]
        second = [[np.zeros_like(p) for p in n.params] for n in nets]
        step = 0
        with _shuffled(mv, self.random_state) as rows:
            for _ in range(self.training_epochs):
                losses = []
                for xs in _batches(rows, self.batch_size):
                    z = enc.forward(xs[0])
                    grads, gz, loss = [None], 0, 0.0
                    for dec, x in zip(decs, xs, strict=True):
                        e = dec.forward(z) - x
                        loss += float((e * e).mean())
                        g, back = dec.backward(2 * e / e.size)
                        grads.append(g)
                        gz = gz + back
                    grads[0] = enc.backward(gz)[0]
                    losses.append(loss)
                    step += 1
                    for net, g, a, b in zip(nets, grads, first, second, strict=True):
                        for p, d, m, v in zip(net.params, g, a, b, strict=True):
                            m += 0.1 * (d - m)
                            v += 0.001 * (d * d - v)
                            p -= self.learning_rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                self.loss_ = float(np.mean(losses))
        return self

    def transform(self, mv):
        """Three views: embedding, reconstruction of view 1, prediction of view 2 (from view 1 alone)."""
        one = MultiviewFrame(mv.df, mv.key, mv.views[:1], mv.label).checked()

        def run(xs):
            z = self.nets_[0].forward(xs[0])
            return [z, self.nets_[1].forward(z), self.nets_[2].forward(z)]

        return _map_nets(one, run)

    def fit_transform(self, mv):
        return self.fit(mv).transform(mv)
