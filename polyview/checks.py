"""Queries whose SQL states what a fitted estimator must satisfy: closed forms on narrow views, invariants, steps from fixed starts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import MultiviewFrame
from .functions import exprs as X
from .operators import cluster, compose, decomposition, deep, embed, selection
from .operators import semi_supervised as semi
from .plans.gram import gram
from .queries import E_, J32, J64, QUERIES, SQL, centroids, long, matrix_rows, register, vectors
from .sources import datasets

_ORDERS = """WITH m AS (SELECT avg(o_totalprice) AS a, avg(o_custkey) AS b, var_pop(o_totalprice) * count(*) AS s11, var_pop(o_custkey) * count(*) AS s22, covar_pop(o_totalprice, o_custkey) * count(*) AS s12 FROM orders),
k AS (SELECT *, 0.9 * s11 + 0.1 AS c11, 0.9 * s22 + 0.1 AS c22 FROM m)"""


def orders(s, d) -> MultiviewFrame:
    return MultiviewFrame.from_columns(s.read.parquet(f"{d}/orders.parquet"), "o_orderkey", [["o_totalprice"], ["o_custkey"]])


@register("mcca_reg_eval", f"{_ORDERS} SELECT round(1 + abs(s12) / sqrt(c11 * c22), 9) AS eval FROM k")
def mcca_reg_eval(s, d):
    """Largest eigenvalue of regularised MCCA on two views of one feature."""
    return s.createDataFrame([(round(float(embed.MCCA(1, regs=0.1).fit(orders(s, d)).evals_[0]), 9),)], "eval double")


@register("mcca_common", f"""{_ORDERS}, c AS (SELECT o_orderkey, ((o_totalprice - a) / sqrt(c11) + sign(s12) * (o_custkey - b) / sqrt(c22)) / sqrt(s11 / c11 + s22 / c22 + 2 * abs(s12) / sqrt(c11 * c22)) AS x FROM orders CROSS JOIN k)
SELECT o_orderkey, round(1000 * x * (SELECT sign(arg_max(x, struct_pack(s := abs(x), k := -o_orderkey))) FROM c), 6) + 0.0 AS common FROM c""")
def mcca_common(s, d):
    """Common scores of the same fit, in thousandths."""
    out = embed.MCCA(1, regs=0.1, multiview_output=False).fit_transform(orders(s, d))
    return out.select(F.col("sample_id").alias("o_orderkey"), (F.round(F.col("common")[0] * 1000, 6) + 0.0).alias("common"))


def second_moments(df: DataFrame, column: str, k: int) -> np.ndarray:
    return gram(MultiviewFrame(df, df.columns[0], (column,), None, (k,))).raw


def identity(k: int) -> str:
    return f"SELECT i, j, CAST(i = j AS INT)::DOUBLE AS val FROM (SELECT CAST(unnest(range({k})) AS INT) AS i) CROSS JOIN (SELECT CAST(unnest(range({k})) AS INT) AS j)"


@register("mcca_common_gram", identity(3))
def mcca_common_gram(s, d):
    """Common scores without regularisation are orthonormal."""
    return matrix_rows(s, second_moments(embed.MCCA(3, multiview_output=False).fit_transform(vectors(s, d)).select("sample_id", "common"), "common", 3))


for _view in (0, 1):

    @register(f"cca_view_gram_{_view}", identity(2))
    def cca_view_gram(s, d, view=_view):
        """Scores of a view are orthogonal, with squared norms of a half."""
        return matrix_rows(s, 2 * second_moments(embed.CCA(2).fit_transform(vectors(s, d)).df.select("sample_id", f"v{view}"), f"v{view}", 2))


@register("kmcca_common_norms", "SELECT CAST(unnest(range(2)) AS INT) AS i, 1.0::DOUBLE AS val")
def kmcca_common_norms(s, d):
    out = embed.KMCCA(2, kernel="rbf", regs=0.5, multiview_output=False).fit_transform(vectors(s, d))
    m = second_moments(out.select("sample_id", "common"), "common", 2)
    return s.createDataFrame([(i, round(float(m[i, i]), 6)) for i in range(2)], "i int, val double")


@register("gcca_norms", "SELECT v AS view, i, 1.0::DOUBLE AS val FROM (SELECT CAST(unnest(range(2)) AS INT) AS v) CROSS JOIN (SELECT CAST(unnest(range(4)) AS INT) AS i)")
def gcca_norms(s, d):
    """Columns of a view's scores have length sqrt(views - 1)."""
    g = gram(embed.GCCA(n_components=4).fit_transform(vectors(s, d)))
    return s.createDataFrame([(v, i, round(float(np.diag(g.raw)[r][i]), 6)) for v, r in enumerate(g.at) for i in range(4)], "view int, i int, val double")


@register("mvmds_gram", identity(2))
def mvmds_gram(s, d):
    return matrix_rows(s, second_moments(embed.MVMDS(2).fit_transform(vectors(s, d)).select("sample_id", "mds"), "mds", 2))


@register("group_pca_variance", f"SELECT round(sum(v), 8) AS variance FROM (SELECT j, var_samp(e[j]) AS v FROM {E_} CROSS JOIN {J64} GROUP BY j)")
def group_pca_variance(s, d):
    """All components of a group PCA have the data's whole variance."""
    return s.createDataFrame([(round(float(decomposition.GroupPCA().fit(vectors(s, d)).explained_variance_.sum()), 8),)], "variance double")


@register("group_ica_covariance", identity(3))
def group_ica_covariance(s, d):
    """Sources of a group ICA are white."""
    g = gram(decomposition.GroupICA(3, multiview_output=False).fit_transform(vectors(s, d)))
    return matrix_rows(s, g.scatter / (g.n - 1))


@register("ajive_energy", f"SELECT CAST((j - 1) // 32 AS INT) AS view, round(sum(v), 6) AS energy, true AS joint_part FROM (SELECT j, var_pop(e[j]) * count(*) AS v FROM {E_} CROSS JOIN {J64} GROUP BY j) GROUP BY 1")
def ajive_energy(s, d):
    """The joint part is a projection: its squares and those of the rest sum to the view's own, and it isn't zero."""
    mv = vectors(s, d)
    model = decomposition.AJIVE([4, 4], 1, reconsider_joint_components=False, random_state=0).fit(mv)
    joint, rows = model.transform(mv), []
    for view, (j, m) in enumerate(zip(joint.views, model.means_, strict=True)):
        both = mv.df.select("sample_id", X.subtract(F.col(f"v{view}"), X.vector(m)).alias("x")).join(joint.df.select("sample_id", F.col(j).alias("j")), "sample_id")
        rows.append(both.agg(F.lit(view).alias("view"), F.sum(X.dot(F.col("j"), F.col("j"))).alias("a"), F.sum(X.sqdist(F.col("x"), F.col("j"))).alias("b")))
    return rows[0].unionByName(rows[1]).select("view", F.round(F.col("a") + F.col("b"), 6).alias("energy"), (F.col("a") > 0.001 * F.col("b")).alias("joint_part"))


_STEP = "arg_min({c}.k, struct_pack(d := list_distance({x}, {c}.{m}), k := {c}.k))"
_KMEANS = f"""WITH c AS (SELECT vec_id AS k, v0, v1 FROM {E_} WHERE vec_id < 3),
p AS (SELECT a.vec_id, a.v0, a.v1, {_STEP.format(c='c', x='a.v0', m='v0')} AS p0, {_STEP.format(c='c', x='a.v1', m='v1')} AS p1 FROM {E_} a CROSS JOIN c GROUP BY 1, 2, 3),
m0 AS (SELECT k, list(x ORDER BY j) AS m FROM (SELECT p1 AS k, j, avg(v0[j]) AS x FROM p CROSS JOIN {J32} GROUP BY 1, 2) GROUP BY 1),
m1 AS (SELECT k, list(x ORDER BY j) AS m FROM (SELECT p0 AS k, j, avg(v1[j]) AS x FROM p CROSS JOIN {J32} GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT p.vec_id, p.v0, p.v1, {_STEP.format(c='m0', x='p.v0', m='m')} AS a FROM p CROSS JOIN m0 GROUP BY 1, 2, 3),
r AS (SELECT p.vec_id, {_STEP.format(c='m1', x='p.v1', m='m')} AS b FROM p CROSS JOIN m1 GROUP BY 1, p.v1),
s AS (SELECT q.* FROM q JOIN r USING (vec_id) WHERE a = b),
t AS (SELECT 0 AS view, a, j, avg(v0[j]) AS x FROM s CROSS JOIN {J32} GROUP BY 1, 2, 3 UNION ALL SELECT 1, a, j, avg(v1[j]) FROM s CROSS JOIN {J32} GROUP BY 1, 2, 3)
SELECT CAST(view AS INT) AS view, CAST(dense_rank() OVER (ORDER BY a) - 1 AS INT) AS cluster, CAST(j - 1 AS INT) AS j, round(x, 6) + 0.0 AS val FROM t"""


@register("kmeans_em_step", _KMEANS)
def kmeans_em_step(s, d):
    """Fitted centroids after one EM step from three rows: each view's means by the other's partition, then the rows on which both agree."""
    km = cluster.MultiviewKMeans(3, init=centroids(s, d), max_iter=2).fit(vectors(s, d))
    rows = [(v, k, j, round(float(c[k, j]), 6) + 0.0) for v, c in enumerate(km.centroids_) for k in range(c.shape[0]) for j in range(c.shape[1])]
    return s.createDataFrame(rows, "view int, cluster int, j int, val double")


for _name, _make in {"spectral_clusters": cluster.MultiviewSpectralClustering, "coreg_clusters": cluster.MultiviewCoRegSpectralClustering}.items():

    @register(_name, "SELECT count(*) AS n, CAST(4 AS BIGINT) AS clusters FROM embeddings")
    def clusters(s, d, make=_make):
        return make(4, random_state=0).fit_predict(vectors(s, d)).agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"))


def levels(s, d, classes: int, gap: float, views: int = 2, noise_views: int = 0) -> MultiviewFrame:
    """Views that lie ``gap`` apart for each value of label modulo ``classes``; further views don't tell."""
    mv = vectors(s, d, (32, 32))
    level = (F.col("y") % classes).cast("int")
    shift = lambda v: F.transform(F.slice(v, 1, 3), lambda x: x + level * gap)
    cols = [shift(F.col(f"v{i % 2}")).alias(f"w{i}") for i in range(views)] + [F.slice("v1", 5 + i, 3).alias(f"w{views + i}") for i in range(noise_views)]
    names = tuple(f"w{i}" for i in range(len(cols)))
    return MultiviewFrame(mv.df.select("sample_id", *cols, level.alias("y")), "sample_id", names, "y", (3,) * len(names))


def partly(mv: MultiviewFrame) -> MultiviewFrame:
    return MultiviewFrame(mv.df.withColumn("y", F.when(F.col("sample_id") % 4 == 0, F.col("y"))), mv.key, mv.views, "y", mv.dims)


@register("cotraining_separable", "SELECT vec_id, CAST(label % 2 AS INT) AS prediction FROM embeddings")
def cotraining_separable(s, d):
    """A quarter of the labels is enough where the classes lie apart."""
    return semi.CTClassifier().fit_predict(partly(levels(s, d, 2, 20.0))).select(F.col("sample_id").alias("vec_id"), "prediction")


@register("cotraining_levels", "SELECT vec_id, CAST(label % 3 AS DOUBLE) AS prediction FROM embeddings")
def cotraining_levels(s, d):
    return semi.CTRegressor().fit_predict(partly(levels(s, d, 3, 50.0))).select(F.col("sample_id").alias("vec_id"), F.round("prediction", 9).alias("prediction"))


@register("majority_vote", "SELECT vec_id, CAST(label % 3 AS INT) AS vote FROM embeddings")
def majority_vote(s, d):
    """Three classifiers, of which one has a view that tells nothing, vote."""
    mv = levels(s, d, 3, 20.0, 2, 1)
    return compose.ViewClassifier(semi.GaussianNB()).fit(mv).predict(mv).select(F.col("sample_id").alias("vec_id"), F.col("prediction").alias("vote"))


QUERIES["view_transformer_inverse"] = lambda s, d: (lambda t, mv: long(t.inverse_transform(t.fit(mv).transform(mv))))(compose.ViewTransformer(compose.PCA()), vectors(s, d))
SQL["view_transformer_inverse"] = SQL["view_split"]


@register("train_test_sizes", "SELECT CAST(ceil(count(*) * 0.25) AS BIGINT) AS test, CAST(count(*) - ceil(count(*) * 0.25) AS BIGINT) AS train FROM embeddings")
def train_test_sizes(s, d):
    train, test = selection.train_test_split(vectors(s, d))
    return s.createDataFrame([(test.df.count(), train.df.count())], "test bigint, train bigint")


@register("gaussian_mixture_classes", "SELECT CAST(unnest([0, 1]) AS INT) AS y, CAST(500 AS BIGINT) AS n")
def gaussian_mixture_classes(s, d):
    return datasets.make_gaussian_mixture(s, 1000, [[0, 0], [4, 4]], np.eye(2)).df.groupBy(F.col("y").cast("int").alias("y")).agg(F.count("*").alias("n"))


@register("deep_cca_gram", identity(2))
def deep_cca_gram(s, d):
    """The last step of deep CCA is a linear CCA of the networks' outputs (all but unregularised)."""
    out = deep.DCCA(2, [16, 2], [16, 2], batch_size=200).fit_transform(vectors(s, d))
    m = 2 * second_moments(out.df.select("sample_id", "v0"), "v0", 2)
    return s.createDataFrame([(i, j, round(float(m[i, j]), 2) + 0.0) for i in range(2) for j in range(2)], "i int, j int, val double")


@register("split_autoencoder_shape", "SELECT count(*) AS n, 4 AS embedded, 32 AS first, 32 AS second FROM embeddings")
def split_autoencoder_shape(s, d):
    out = deep.SplitAE(16, 1, 4, batch_size=64).fit_transform(vectors(s, d))
    return out.df.agg(F.count("*").alias("n"), *[F.max(F.size(v)).alias(n) for v, n in zip(out.views, ("embedded", "first", "second"), strict=True)])
