"""Splits, cross-validation, metrics and plot tables."""

from __future__ import annotations

import copy
import math
import time
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MultiviewFrame


def portable_key(key: Column, seed: int) -> Column:
    """A scrambled integer of an integer key that other SQL engines can repeat."""
    return (key * 7919 + seed * 104729) % 10007


def split_flags(df: DataFrame, key: str, test_size: float = 0.25, seed: int = 0, stratify: str | None = None) -> DataFrame:
    """``df`` with is_test; ceil(test_size * n) rows (of each stratum) are test rows, by scrambled key.

    A row's place is the number of rows of lesser scrambled keys, from a count of each, plus its place
    among the rows of its own, so that no window holds a whole stratum.
    """
    place = {"__stratum": F.col(stratify) if stratify else F.lit(""), "__key": portable_key(F.col(key), seed)}
    counts = df.groupBy(*[c.alias(n) for n, c in place.items()]).agg(F.count("*").alias("__n"))
    stratum = Window.partitionBy("__stratum")
    counts = counts.select(F.col("__stratum").alias("__s"), F.col("__key").alias("__k"), (F.sum("__n").over(stratum.orderBy("__key")) - F.col("__n")).alias("__before"), F.sum("__n").over(stratum).alias("__all"))
    if not stratify:  # a scrambled key has 10,007 values
        counts = F.broadcast(counts)
    rows = df.withColumns(place | {"__rank": F.row_number().over(Window.partitionBy(*place.values()).orderBy(key))})
    found = rows.join(counts, rows["__stratum"].eqNullSafe(counts["__s"]) & rows["__key"].eqNullSafe(counts["__k"]))
    return found.withColumn("is_test", F.col("__before") + F.col("__rank") <= F.ceil(F.col("__all") * F.lit(test_size))).select(*df.columns, "is_test")


def train_test_split(mv: MultiviewFrame, test_size: float = 0.25, seed: int = 0, stratify: bool = False) -> tuple[MultiviewFrame, MultiviewFrame]:
    """Exact sizes at any scale: the cut is a quantile of a 64-bit hash, found by radix counts, not by one ordered window."""
    if stratify:
        flagged = split_flags(mv.df, mv.key, test_size, seed, mv.label)
        return replace(mv, df=flagged.where("NOT is_test").drop("is_test")), replace(mv, df=flagged.where("is_test").drop("is_test"))
    h = F.xxhash64(F.col(mv.key), F.lit(seed))
    want, prefix, lo = math.ceil(test_size * mv.df.count()), mv.df.select(F.shiftrightunsigned(h, 0).alias("h")), 0
    for shift in (48, 32, 16, 0):  # radix selection: at most 65536 counts reach the driver at a time
        digit = F.shiftrightunsigned(F.col("h"), shift).bitwiseAND(F.lit(0xFFFF))
        seen = 0
        for d, n in sorted((r[0], r[1]) for r in prefix.groupBy(digit.alias("d")).count().collect()):
            if seen + n >= want:
                break
            seen += n
        want -= seen
        prefix = prefix.where(digit == d)
        lo = lo << 16 | d
    cut, u = lo ^ (1 << 63), h.bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order as signed order
    cut = cut - (1 << 64) if cut >= 1 << 63 else cut
    return replace(mv, df=mv.df.where(u > cut)), replace(mv, df=mv.df.where(u <= cut))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with a fold number by scrambled key."""
    return df.withColumn("fold", (portable_key(F.col(key), seed) % k).cast("int"))


def cross_validate(estimator, mv: MultiviewFrame, k: int = 5, seed: int = 0, scoring=None, return_train_score: bool = False, return_estimator: bool = False) -> dict[str, list]:
    """Times and scores of each fold. ``scoring``: a function of (estimator, frame), or a dict of them by name; the estimator's own score otherwise."""
    scorers = scoring if isinstance(scoring, dict) else {"score": scoring or (lambda e, x: e.score(x))}
    out: dict[str, list] = {"fit_time": [], "score_time": [], **{f"test_{name}": [] for name in scorers}}
    if return_train_score:
        out |= {f"train_{name}": [] for name in scorers}
    if return_estimator:
        out["estimator"] = []
    df = folds(mv.df, mv.key, k, seed)
    for i in range(k):
        train, test = (replace(mv, df=df.where(c).drop("fold")) for c in (F.col("fold") != i, F.col("fold") == i))
        own, t = copy.deepcopy(estimator), time.time()
        own.fit(train)
        out["fit_time"].append(time.time() - t)
        t = time.time()
        for name, f in scorers.items():
            out[f"test_{name}"].append(f(own, test))
        out["score_time"].append(time.time() - t)
        if return_train_score:
            for name, f in scorers.items():
                out[f"train_{name}"].append(f(own, train))
        if return_estimator:
            out["estimator"].append(own)
    return out


def mean_squared_error(df: DataFrame, a: str, b: str) -> float:
    return df.agg(F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))).first()[0]


def accuracy(df: DataFrame, a: str, b: str) -> float:
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("double"))).first()[0]


def label_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: nmi (arithmetic), homogeneity of ``b`` against ``a``, from the contingency table."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    cells = cells.select("*", total.alias("t"), F.sum("n").over(Window.partitionBy(a)).alias("na"), F.sum("n").over(Window.partitionBy(b)).alias("nb"))
    p = F.col("n") / F.col("t")
    mi = F.sum(p * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb"))))
    ha, hb = -F.sum(p * F.log(F.col("na") / F.col("t"))), -F.sum(p * F.log(F.col("nb") / F.col("t")))
    row = cells.agg(mi.alias("mi"), ha.alias("ha"), hb.alias("hb"))
    return row.select(F.when((F.col("ha") + F.col("hb")) > 0, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).otherwise(1.0).alias("nmi"), F.when(F.col("ha") > 0, F.col("mi") / F.col("ha")).otherwise(1.0).alias("homogeneity"))


def crossviews_table(mv: MultiviewFrame, dimensions=None) -> DataFrame:
    """Points of every pair of dimensions of two views: (sample, dim1, dim2, x, y, label), ready to draw."""
    mv = mv.checked()
    if len(mv.views) != 2:
        raise ValueError("two views are needed")
    d = dimensions or [range(mv.dims[0]), range(mv.dims[1])]
    if any(i < 0 or i >= w for ids, w in zip(d, mv.dims, strict=True) for i in ids):
        raise ValueError("a dimension is out of range")
    pairs = F.array(*[F.struct(F.lit(i).alias("dim1"), F.lit(j).alias("dim2"), F.col(mv.views[0])[i].alias("x"), F.col(mv.views[1])[j].alias("y")) for i in d[0] for j in d[1]])
    label = [F.col(mv.label).alias("label")] if mv.label else []
    return mv.df.select(mv.key, *label, F.explode(pairs).alias("p")).select(mv.key, *(["label"] if label else []), "p.*")


def quick_table(mv: MultiviewFrame) -> DataFrame:
    """Two scaling coordinates of every sample."""
    from .embed import MVMDS

    return MVMDS(2).fit_transform(mv).select(mv.key, *([F.col(mv.label).alias("label")] if mv.label else []), F.col("mds")[0].alias("x"), F.col("mds")[1].alias("y"))
