"""Loaders of multi-view files and simulators; every simulated row is a function of its key and the seed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import MultiviewFrame
from ..functions import exprs as X
from ..functions.linalg import rand_orthog


def read_views(spark: SparkSession, paths: list[str], key: str, fmt: str = "parquet", label: str | None = None) -> MultiviewFrame:
    """One table per view, all with ``key``; the other numeric columns are the features, in order."""
    out, views, widths = None, [], []
    for i, p in enumerate(paths):
        df = spark.read.options(header=True, inferSchema=True).format(fmt).load(p)
        cols = [c for c, t in df.dtypes if c not in (key, label) and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
        part = df.select(F.col(key).alias("sample_id"), F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias(f"v{i}"), *([F.col(label).alias("y")] if label and label in df.columns and i == 0 else []))
        out = part if out is None else out.join(part, "sample_id")
        views.append(f"v{i}")
        widths.append(len(cols))
    return MultiviewFrame(out, "sample_id", tuple(views), "y" if label else None, tuple(widths))


def _numbered_csv(spark, path):
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.columns, df.withColumn("__at", F.monotonically_increasing_id())


def load_nutrimouse(spark: SparkSession, folder: str) -> MultiviewFrame:
    """gene.csv and lipid.csv as views, genotype.csv and diet.csv as codes in alphabetical order (y, y2). Rows pair up by position, so each file is read as one partition."""
    frames = []
    for name in ("gene", "lipid", "genotype", "diet"):
        cols, df = _numbered_csv(spark, f"{folder}/{name}.csv")
        df = df.coalesce(1)
        row = F.row_number().over(Window.orderBy("__at")) - 1
        if name in ("gene", "lipid"):
            frames.append(df.select(row.cast("long").alias("sample_id"), F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("v0" if name == "gene" else "v1")))
        else:
            frames.append(df.select(row.cast("long").alias("sample_id"), (F.dense_rank().over(Window.orderBy(f"`{cols[-1]}`")) - 1).alias("y" if name == "genotype" else "y2"), "__at").drop("__at"))
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, "sample_id")
    return MultiviewFrame(out, "sample_id", ("v0", "v1"), "y")


def load_multifeature(spark: SparkSession, paths: list[str], select_labeled="all", views="all", shuffle: bool = False, random_state: int = 0) -> MultiviewFrame:
    """Feature files (last column = label) with rows in the same order; keep some labels and views. ``shuffle`` numbers the rows anew, in the order of a hash."""
    out, names = None, []
    for i in range(len(paths)) if views == "all" else views:
        cols, df = _numbered_csv(spark, paths[i])
        part = df.coalesce(1).select((F.row_number().over(Window.orderBy("__at")) - 1).cast("long").alias("sample_id"), F.array(*[F.col(f"`{c}`").cast("double") for c in cols[:-1]]).alias(f"v{len(names)}"), F.col(f"`{cols[-1]}`").cast("int").alias("y"))
        out = part if out is None else out.join(part.drop("y"), "sample_id")
        names.append(f"v{len(names)}")
    if select_labeled != "all":
        out = out.where(F.col("y").isin(list(select_labeled)))
    if shuffle:
        out = out.withColumn("sample_id", (F.row_number().over(Window.orderBy(F.xxhash64("sample_id", F.lit(random_state)), "sample_id")) - 1).cast("long"))
    return MultiviewFrame(out, "sample_id", tuple(names), "y")


def normal(key, salt: int):
    """A standard normal that is a function of key and salt (Box-Muller on two hashes)."""
    u = [(F.shiftrightunsigned(F.xxhash64(key, F.lit(salt), F.lit(k)), 11).cast("double") + 0.5) / float(1 << 53) for k in (0, 1)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])


def _normals(key, n: int, salt: int):
    return F.array(*[normal(key, salt * 1000 + j) for j in range(n)])


def make_gaussian_mixture(spark: SparkSession, n_samples: int, centers, covariances, transform="linear", noise=None, noise_dims=None, class_probs=None, seed: int = 0, return_latents: bool = False):
    """View 0 is a Gaussian mixture, view 1 a rotation ('linear'), square ('poly'), sine ('sin') or ``transform(column)`` of it; ``noise`` is a variance. With ``return_latents`` also the frame of the mixture without noise."""
    centers, covs = np.atleast_2d(centers), np.asarray(covariances, float)
    d, k = centers.shape[1], len(centers)
    covs = np.broadcast_to(covs, (k, d, d)) if covs.ndim == 2 else covs
    probs = [1 / k] * k if class_probs is None else class_probs
    if abs(sum(probs) - 1) > 1e-9 or len(probs) != k:
        raise ValueError("class_probs must be as many as centers and sum to 1")
    counts = [int(p * n_samples) for p in probs]
    ends = np.cumsum(counts)
    key = F.col("sample_id")
    df = spark.range(int(ends[-1])).withColumnRenamed("id", "sample_id")
    y = sum(((key >= int(e)).cast("int") for e in ends[:-1]), F.lit(0))
    df = df.withColumn("y", y).withColumn("z", _normals(key, d, seed + 1))
    latent = None
    for c in range(k):
        x = F.zip_with(X.project(F.col("z"), np.linalg.cholesky(covs[c]).T), X.vector(centers[c]), lambda a, b: a + b)
        latent = F.when(F.col("y") == c, x) if latent is None else latent.when(F.col("y") == c, x)
    df = df.withColumn("latent", latent)
    v = F.col("latent")
    if callable(transform):
        second = transform(v)
    elif transform == "linear":
        second = F.transform(v, lambda x: -x) if d == 1 else X.project(v, rand_orthog(d, d, np.random.default_rng(2)))
    elif transform in ("poly", "sin"):
        second = F.transform(v, (lambda x: x * x) if transform == "poly" else F.sin)
    else:
        raise ValueError("transform must be linear, poly, sin or a function of a column")
    views = [v, second]
    if noise is not None:
        views = [F.zip_with(x, _normals(key, d, seed + 10 + i), lambda a, e: a + e * float(np.sqrt(noise))) for i, x in enumerate(views)]
    if noise_dims:
        views = [F.concat(x, _normals(key, noise_dims, seed + 20 + i)) for i, x in enumerate(views)]
    out = MultiviewFrame(df.select("sample_id", "y", views[0].alias("v0"), views[1].alias("v1")), "sample_id", ("v0", "v1"), "y", (d + (noise_dims or 0),) * 2)
    return (out, MultiviewFrame(df.select("sample_id", "y", v.alias("v0")), "sample_id", ("v0",), "y", (d,))) if return_latents else out


def sample_joint_factor_model(spark: SparkSession, n_samples: int, n_features: list[int], joint_rank=1, noise_std=1.0, m=1.5, seed: int = 0, return_decomp: bool = False):
    """X_b = U diag(s) W_b' + noise; columns of U are normals made orthonormal through their Gram matrix. With ``return_decomp`` also (frame of U, s, list of W_b)."""
    from ..plans.gram import gram

    rng, key = np.random.default_rng(seed), F.col("sample_id")
    base = spark.range(n_samples).withColumnRenamed("id", "sample_id").withColumn("v0", _normals(key, joint_rank, seed + 1))
    g = gram(MultiviewFrame(base, "sample_id", ("v0",), None, (joint_rank,)))
    low = np.linalg.inv(np.linalg.cholesky(g.raw)).T
    s = np.arange(1, joint_rank + 1) * m * noise_std * (n_samples * max(n_features)) ** 0.25
    views, ws = [], []
    for i, d in enumerate(n_features):
        w = rand_orthog(d, joint_rank, rng)
        ws.append(w)
        views.append(F.zip_with(X.project(F.col("v0"), low * s @ w.T), _normals(key, d, seed + 2 + i), lambda a, e: a + e * float(noise_std)).alias(f"v{i}"))
    out = MultiviewFrame(base.select("sample_id", *views), "sample_id", tuple(f"v{i}" for i in range(len(n_features))), None, tuple(n_features))
    return (out, (MultiviewFrame(base.select("sample_id", X.project(F.col("v0"), low).alias("v0")), "sample_id", ("v0",), None, (joint_rank,)), s, ws)) if return_decomp else out


def load_embeddings(spark: SparkSession, sf_dir: str, widths=(32, 32)) -> MultiviewFrame:
    """The embeddings table cut into views."""
    df: DataFrame = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return MultiviewFrame.from_vector(df, "vec_id", "embedding", widths, "label")
