"""The one aggregation behind the linear methods: counts, means and the scatter matrix of all views."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa

from ..frame import MultiviewFrame
from ..functions.linalg import blocks


@dataclass
class Gram:
    """scatter is X'X about the means; raw adds them back."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    dims: tuple[int, ...]
    fourth: float = 0.0  # sum of squared norms, squared, about the origin

    @property
    def at(self):
        return blocks(self.dims)

    @property
    def means(self):
        return [self.mean[s] for s in self.at]

    @property
    def raw(self):
        return self.scatter + self.n * np.outer(self.mean, self.mean)

    def block(self, a: int, b: int) -> np.ndarray:
        return self.scatter[self.at[a], self.at[b]]


def matrices(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of all list columns of a batch, side by side."""
    return np.hstack([c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in batch.columns]) if batch.num_rows else np.zeros((0, 0))


def summed(mv: MultiviewFrame, part: Callable[[np.ndarray], list[np.ndarray]], merge: Callable[[list, list], list] | None = None, fan_in: int = 16):
    """Reduce arrays that ``part`` makes from the rows of each batch: per partition, then in ``fan_in`` groups, then on the driver."""
    merge = merge or (lambda a, b: [x + y for x, y in zip(a, b, strict=True)])
    if mv.local is not None:
        return reduce(merge, (part(mv.local[i : i + 10_000]) for i in range(0, len(mv.local), 10_000)))

    def encode(arrays):
        return [a.astype("<f8").tobytes() for a in arrays], [list(a.shape) for a in arrays]

    def row(group, arrays):
        data, shapes = encode(arrays)
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([data], pa.list_(pa.binary())), pa.array([shapes], pa.list_(pa.list_(pa.int32())))], ["g", "data", "shapes"])

    def decode(data, shapes):
        return [np.frombuffer(d, "<f8").reshape(s) for d, s in zip(data, shapes, strict=True)]

    def first(batches):
        from pyspark import TaskContext

        held = None
        for b in batches:
            if b.num_rows:
                new = part(matrices(b))
                held = new if held is None else merge(held, new)
        if held is not None:
            yield row(TaskContext.get().partitionId() % fan_in, held)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for _, d, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held = decode(d, s) if held is None else merge(held, decode(d, s))
        yield row(0, held)

    schema = "g int, data array<binary>, shapes array<array<int>>"
    held = None
    for r in mv.df.select(*mv.views).mapInArrow(first, schema).groupBy("g").applyInArrow(second, schema).collect():
        new = decode([bytes(d) for d in r["data"]], r["shapes"])
        held = new if held is None else merge(held, new)
    return held


def gram(mv: MultiviewFrame) -> Gram:
    """One pass: scatter about each batch's own mean, merged pairwise, so large means cost no digits."""

    def part(x):
        m = x.mean(axis=0)
        return [np.array([float(len(x))]), m, (x - m).T @ (x - m), np.array([((x * x).sum(axis=1) ** 2).sum()])]

    def merge(a, b):
        n = a[0] + b[0]
        d = b[1] - a[1]
        return [n, a[1] + d * b[0] / n, a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n), a[3] + b[3]]

    mv = mv if mv.dims else mv.checked()
    n, mean, scatter, fourth = summed(mv, part, merge)
    return Gram(int(n[0]), mean, scatter, mv.dims, float(fourth[0]))


def merged(a: Gram | None, b: Gram) -> Gram:
    """The Gram matrix of the rows of both."""
    if a is None:
        return b
    n, d = a.n + b.n, b.mean - a.mean
    return Gram(n, a.mean + d * (b.n / n), a.scatter + b.scatter + np.outer(d, d) * (a.n * b.n / n), a.dims, a.fourth + b.fourth)
