"""Multi-view data: one DataFrame with a sample key and one ARRAY<DOUBLE> column per view."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Views of at most so many bytes are held by the driver while an iterative method passes over them.
LOCAL_BYTES = 64 << 20


@dataclass(frozen=True)
class MultiviewFrame:
    """``views`` are columns of ``df`` that share the rows named by ``key``; an unlabelled row has a null ``label``."""

    df: DataFrame
    key: str = "sample_id"
    views: tuple[str, ...] = ("v0", "v1")
    label: str | None = None
    dims: tuple[int, ...] = field(default=())
    local: np.ndarray | None = field(default=None, compare=False, repr=False)

    @classmethod
    def from_columns(cls, df: DataFrame, key: str, columns: Sequence[Sequence[str]], label: str | None = None) -> MultiviewFrame:
        """Views from lists of numeric columns."""
        views = [F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias(f"v{i}") for i, cols in enumerate(columns)]
        out = df.select(F.col(key).alias("sample_id"), *views, *([F.col(label).alias("y")] if label else []))
        return cls(out, "sample_id", tuple(f"v{i}" for i in range(len(columns))), "y" if label else None, tuple(map(len, columns)))

    @classmethod
    def from_vector(cls, df: DataFrame, key: str, column: str, widths: Sequence[int], label: str | None = None) -> MultiviewFrame:
        """Views that are consecutive ranges of one vector column."""
        v, at, views = F.col(column).cast("array<double>"), 1, []
        for i, w in enumerate(widths):
            views.append(F.slice(v, at, w).alias(f"v{i}"))
            at += w
        out = df.select(F.col(key).alias("sample_id"), *views, *([F.col(label).alias("y")] if label else []))
        return cls(out, "sample_id", tuple(f"v{i}" for i in range(len(widths))), "y" if label else None, tuple(widths))

    @classmethod
    def from_views(cls, frames: Sequence[DataFrame], key: str, column: str = "v") -> MultiviewFrame:
        """Views in separate tables, joined on the key; a key that a table lacks is an error."""
        parts = [f.select(F.col(key).alias("sample_id"), F.col(column).cast("array<double>").alias(f"v{i}")) for i, f in enumerate(frames)]
        out = reduce(lambda a, b: a.join(b, "sample_id", "full"), parts)
        views = tuple(f"v{i}" for i in range(len(parts)))
        if not out.where(reduce(lambda a, b: a | b, [F.col(v).isNull() for v in views])).isEmpty():
            raise ValueError("views have different samples")
        return cls(out, "sample_id", views)

    @contextmanager
    def pinned(self):
        """The frame for many passes over the same rows: views of up to LOCAL_BYTES (rows are counted first) are also held here, side by side in ``local``; larger ones are cached by the executors."""
        mv = self if self.dims else self.checked()
        if mv.df.count() * sum(mv.dims) * 8 <= LOCAL_BYTES:
            table = mv.df.select(*mv.views).toArrow()
            columns = [table[v].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1) for v in mv.views]
            yield replace(mv, local=np.hstack(columns))
            return
        df = mv.df.select(*mv.keep(), *mv.views).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield replace(mv, df=df)
        finally:
            df.unpersist()

    def cols(self) -> list[Column]:
        return [F.col(v) for v in self.views]

    def keep(self) -> list[str]:
        """Key and label."""
        return [self.key, *([self.label] if self.label else [])]

    def with_views(self, views: Sequence[Column], dims: Sequence[int] = ()) -> MultiviewFrame:
        names = [f"v{i}" for i in range(len(views))]
        out = self.df.select(*self.keep(), *[v.alias(n) for v, n in zip(views, names, strict=True)])
        return replace(self, df=out, views=tuple(names), dims=tuple(dims), local=None)

    def checked(self, multiview: bool = False, enforce_views: int | None = None, finite: bool = True) -> MultiviewFrame:
        """The frame with its widths, after one validating aggregate."""
        if not self.views:
            raise ValueError("there are no views")
        if multiview and len(self.views) == 1:
            raise ValueError("more than one view is needed")
        if enforce_views is not None and len(self.views) != enforce_views:
            raise ValueError(f"expected {enforce_views} views, got {len(self.views)}")
        aggs = [F.count("*").alias("n")]
        for v in self.views:
            bad = F.col(v).isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            aggs += [F.min(F.size(v)).alias(f"lo_{v}"), F.max(F.size(v)).alias(f"hi_{v}"), F.count_if(bad).alias(f"bad_{v}")]
        row = self.df.agg(*aggs).first()
        if not row.n:
            raise ValueError("there are no samples")
        dims = []
        for v in self.views:
            if row[f"lo_{v}"] != row[f"hi_{v}"] or row[f"hi_{v}"] < 1:
                raise ValueError(f"rows of {v} differ in width or are empty")
            if finite and row[f"bad_{v}"]:
                raise ValueError(f"{v} has null or non-finite values")
            dims.append(row[f"hi_{v}"])
        return replace(self, dims=tuple(dims))

    def checked_labels(self, num_classes: int | None = None, max_classes: int | None = None) -> MultiviewFrame:
        """Checks numbers of classes; nulls (unlabelled) don't count."""
        n = self.df.agg(F.count_distinct(self.label)).first()[0]
        if num_classes is not None and n != num_classes:
            raise ValueError(f"expected {num_classes} classes, got {n}")
        if max_classes is not None and n > max_classes:
            raise ValueError(f"expected at most {max_classes} classes, got {n}")
        return self
