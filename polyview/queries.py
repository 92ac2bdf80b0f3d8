"""Queries of the multi-view engine over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import MultiviewFrame
from .functions import exprs as X
from .operators import cluster, compose, decomposition, deep, embed, selection
from .operators import semi_supervised as semi
from .plans.gram import gram
from .sources import datasets

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def vectors(spark, d, widths=(32, 32)) -> MultiviewFrame:
    return datasets.load_embeddings(spark, d, widths)


def prices(spark, d) -> MultiviewFrame:
    """Two narrow views of lineitem; its rows have no key, so only aggregates are asked of it."""
    df = spark.read.parquet(f"{d}/lineitem.parquet")
    return MultiviewFrame.from_columns(df, "l_orderkey", [["l_quantity", "l_extendedprice"], ["l_discount", "l_tax"]])


def long(mv: MultiviewFrame) -> DataFrame:
    """(vec_id, view, j, val), one row per feature."""
    views = F.array(*[F.struct(F.lit(i).alias("view"), F.col(v).alias("x")) for i, v in enumerate(mv.views)])
    rows = mv.df.select(F.col(mv.key).alias("vec_id"), F.explode(views).alias("e")).select("vec_id", "e.view", F.posexplode("e.x").alias("j", "val"))
    return rows.select("vec_id", "view", "j", F.round(F.col("val") + 0.0, 6).alias("val"))


def values_of(m: np.ndarray) -> str:
    return "[" + ", ".join(repr(float(x)) for x in m) + "]::DOUBLE[]"


E_ = "(SELECT vec_id, label, embedding::DOUBLE[] AS e, embedding[1:32]::DOUBLE[] AS v0, embedding[33:64]::DOUBLE[] AS v1 FROM embeddings)"
J32, J64 = "(SELECT unnest(range(1, 33)) AS j)", "(SELECT unnest(range(1, 65)) AS j)"

register("view_split", f"SELECT vec_id, 0 AS view, CAST(j - 1 AS INT) AS j, round(v0[j] + 0.0, 6) AS val FROM {E_} CROSS JOIN {J32} UNION ALL SELECT vec_id, 1, CAST(j - 1 AS INT), round(v1[j] + 0.0, 6) FROM {E_} CROSS JOIN {J32}")(
    lambda s, d: long(compose.SimpleSplitter([32, 32]).transform(vectors(s, d, (64,))))
)
register("view_concat", f"SELECT vec_id, 0 AS view, CAST(j - 1 AS INT) AS j, round(e[j] + 0.0, 6) AS val FROM {E_} CROSS JOIN {J64}")(lambda s, d: long(compose.ConcatMerger().fit_transform(vectors(s, d))))
QUERIES["view_concat_inverse"] = lambda s, d: (lambda m, mv: long(m.inverse_transform(m.fit_transform(mv))))(compose.ConcatMerger(), vectors(s, d))
SQL["view_concat_inverse"] = SQL["view_split"]
register("view_average", f"SELECT vec_id, 0 AS view, CAST(j - 1 AS INT) AS j, round((v0[j] + v1[j]) / 2, 6) + 0.0 AS val FROM {E_} CROSS JOIN {J32}")(lambda s, d: long(compose.AverageMerger().fit_transform(vectors(s, d))))

_SUB = [np.random.default_rng(7).choice(64, 5, replace=False)]
register("random_subspace", f"SELECT vec_id, 0 AS view, CAST(j - 1 AS INT) AS j, round(e[([{', '.join(str(int(i) + 1) for i in _SUB[0])}])[j]] + 0.0, 6) AS val FROM {E_} CROSS JOIN (SELECT unnest(range(1, 6)) AS j)")(
    lambda s, d: long(compose.RandomSubspaceMethod(1, 5, 7).fit_transform(vectors(s, d, (64,))))
)
_PROJ = np.random.default_rng(9).standard_normal((64, 3)) / np.sqrt(3)
register("gaussian_projection", " UNION ALL ".join(f"SELECT vec_id, 0 AS view, {k} AS j, round(list_inner_product(e, {values_of(_PROJ[:, k])}) + 0.0, 6) AS val FROM {E_}" for k in range(3)))(
    lambda s, d: long(compose.RandomGaussianProjection(1, 3, random_state=9).fit_transform(vectors(s, d, (64,))))
)


@register("view_center", f"WITH l AS (SELECT vec_id, j, e[j] AS x FROM {E_} CROSS JOIN {J64}) SELECT vec_id, CAST((j - 1) // 32 AS INT) AS view, CAST((j - 1) % 32 AS INT) AS j, round(x - avg(x) OVER (PARTITION BY j) + 0.0, 6) AS val FROM l")
def view_center(s, d):
    mv = vectors(s, d)
    return long(mv.with_views([X.subtract(v, X.vector(m)) for v, m in zip(mv.cols(), gram(mv).means, strict=True)], mv.dims))


register("gcca_center", f"WITH l AS (SELECT vec_id, (j - 1) // 32 AS view, (j - 1) % 32 AS j, e[j] AS x FROM {E_} CROSS JOIN {J64}) SELECT vec_id, CAST(view AS INT) AS view, CAST(j AS INT) AS j, round((x - avg(x) OVER w) / stddev_samp(x) OVER w + 0.0, 6) AS val FROM l WINDOW w AS (PARTITION BY vec_id, view)")(
    lambda s, d: long(embed.GCCA.row_scaled(vectors(s, d)))
)


def matrix_rows(spark, m: np.ndarray, names=("i", "j", "val")) -> DataFrame:
    rows = [(int(i), int(j), round(float(m[i, j]), 6) + 0.0) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, f"{names[0]} int, {names[1]} int, {names[2]} double")


register("cross_gram", f"WITH l AS (SELECT vec_id, j, e[j] AS x FROM {E_} CROSS JOIN {J64}), c AS (SELECT vec_id, j, x - avg(x) OVER (PARTITION BY j) AS x FROM l) SELECT CAST(a.j - 1 AS INT) AS i, CAST(b.j - 33 AS INT) AS j, round(sum(a.x * b.x), 6) + 0.0 AS val FROM c a JOIN c b ON a.vec_id = b.vec_id WHERE a.j <= 32 AND b.j > 32 GROUP BY 1, 2")(
    lambda s, d: matrix_rows(s, gram(vectors(s, d)).block(0, 1))
)


@register("lineitem_cov", "SELECT round(var_samp(l_quantity), 4) AS qq, round(covar_samp(l_quantity, l_extendedprice), 4) AS qp, round(covar_samp(l_quantity, l_discount), 6) AS qd, round(covar_samp(l_discount, l_tax), 6) AS dt FROM lineitem")
def lineitem_cov(s, d):
    g = gram(prices(s, d))
    c = g.scatter / (g.n - 1)
    return s.createDataFrame([tuple(round(float(v), k) for v, k in ((c[0, 0], 4), (c[0, 1], 4), (c[0, 2], 6), (c[2, 3], 6)))], "qq double, qp double, qd double, dt double")


@register("cca_1feature_stats", "WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem) SELECT round(abs(r), 6) AS r, round(1 - r * r, 6) AS wilks, CAST(n - 2 AS DOUBLE) AS df2, round(r * r / (1 - r * r) * (n - 2), 4) AS f, round(-(n - 2.5) * ln(1 - r * r), 4) AS chisq FROM c")
def cca_1feature_stats(s, d):
    mv = MultiviewFrame.from_columns(s.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", [["l_quantity"], ["l_extendedprice"]])
    cca = embed.CCA(1)
    got = cca.stats(cca.fit_transform(mv))
    return s.createDataFrame([(round(float(got["r"][0]), 6), round(float(got["Wilks"][0]), 6), float(got["df2"][0]), round(float(got["F"][0]), 4), round(float(got["chisq"][0]), 4))], "r double, wilks double, df2 double, f double, chisq double")


_COV4 = ", ".join(f"covar_pop({a}, {b}) AS {x}{y}" for x, a in (("a", "l_quantity"), ("b", "l_extendedprice"), ("c", "l_discount"), ("d", "l_tax")) for y, b in (("a", "l_quantity"), ("b", "l_extendedprice"), ("c", "l_discount"), ("d", "l_tax")) if x <= y)


@register("cca_2x2", f"""WITH m AS (SELECT {_COV4} FROM lineitem), p AS (SELECT *, aa * bb - ab * ab AS d1, cc * dd - cd * cd AS d2 FROM m),
t AS (SELECT ((bb * ac - ab * bc) * (dd * ac - cd * ad) + (bb * ad - ab * bd) * (cc * ad - cd * ac) + (aa * bc - ab * ac) * (dd * bc - cd * bd) + (aa * bd - ab * ad) * (cc * bd - cd * bc)) / (d1 * d2) AS tr,
((ac * bd - ad * bc) * (ac * bd - ad * bc)) / (d1 * d2) AS det FROM p)
SELECT round(sqrt((tr + sqrt(greatest(tr * tr - 4 * det, 0))) / 2), 5) AS r1, round(sqrt(greatest((tr - sqrt(greatest(tr * tr - 4 * det, 0))) / 2, 0)), 5) AS r2 FROM t""")
def cca_2x2(s, d):
    cca = embed.CCA(2).fit(prices(s, d))
    r = [round(float(v) - 1, 5) + 0.0 for v in cca.evals_]
    return s.createDataFrame([tuple(r)], "r1 double, r2 double")


@register("pca_2d", "WITH m AS (SELECT var_samp(l_discount) AS a, covar_samp(l_discount, l_tax) AS b, var_samp(l_tax) AS c FROM lineitem) SELECT round((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2, 8) AS e1, round((a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2, 8) AS e2 FROM m")
def pca_2d(s, d):
    p = compose.PCA(2).fit(MultiviewFrame.from_columns(s.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", [["l_discount", "l_tax"]]))
    return s.createDataFrame([tuple(round(float(v), 8) for v in p.explained_variance_)], "e1 double, e2 double")


def centroids(s, d, k=3):
    rows = vectors(s, d).df.where(F.col("sample_id") < k).orderBy("sample_id").collect()
    return [np.array([r[v] for r in rows]) for v in ("v0", "v1")]


_PICK = "arg_min({k}, struct_pack(d := {d}, k := {k}))"
_PRED = f"SELECT a.vec_id, CAST(arg_min(c.vec_id, struct_pack(d := {{d}}, k := c.vec_id)) AS INT) AS cluster FROM {E_} a CROSS JOIN (SELECT * FROM {E_} WHERE vec_id < 3) c GROUP BY a.vec_id"


@register("kmeans_predict", _PRED.format(d="list_distance(a.v0, c.v0) + list_distance(a.v1, c.v1)"))
def kmeans_predict(s, d):
    km = cluster.MultiviewKMeans(3)
    km.centroids_ = centroids(s, d)
    return km.predict(vectors(s, d)).select(F.col("sample_id").alias("vec_id"), "cluster")


@register("spherical_kmeans_predict", _PRED.format(d="2 - list_cosine_similarity(a.v0, c.v0) - list_cosine_similarity(a.v1, c.v1)"))
def spherical_kmeans_predict(s, d):
    km = cluster.MultiviewSphericalKMeans(3)
    km.centroids_ = [c / np.linalg.norm(c, axis=1, keepdims=True) for c in centroids(s, d)]
    return km.predict(vectors(s, d)).select(F.col("sample_id").alias("vec_id"), "cluster")


@register("nb_predict", f"""WITH l AS (SELECT vec_id, label, j, v0[j] AS x FROM {E_} CROSS JOIN {J32}), m AS (SELECT label, j, avg(x) AS mu, var_pop(x) AS var, count(*) AS n FROM l GROUP BY 1, 2),
sm AS (SELECT 1e-9 * max(v) AS eps FROM (SELECT j, var_pop(x) AS v FROM l GROUP BY j)), t AS (SELECT count(*) AS n FROM embeddings),
z AS (SELECT l.vec_id, m.label, max(ln(m.n * 1.0 / t.n)) - 0.5 * sum(ln(2 * pi() * (m.var + eps)) + (l.x - m.mu) * (l.x - m.mu) / (m.var + eps)) AS s FROM l JOIN m USING (j) CROSS JOIN sm CROSS JOIN t GROUP BY 1, 2)
SELECT vec_id, CAST(arg_max(label, struct_pack(s := s, l := -label)) AS INT) AS prediction FROM z GROUP BY vec_id""")
def nb_predict(s, d):
    mv = vectors(s, d).checked()
    nb = semi.GaussianNB().fit(mv)
    return mv.df.select(F.col("sample_id").alias("vec_id"), nb.predict_column(F.col("v0")).alias("prediction"))


_SCR = "(({k} * 7919 + {s} * 104729) % 10007)"
register("train_test_split", f"WITH o AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_SCR.format(k='o_orderkey', s=1)}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, r <= ceil(n * 0.25::DOUBLE) AS is_test FROM o")(
    lambda s, d: selection.split_flags(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus"), "o_orderkey", 0.25, 1, "o_orderstatus").select("o_orderkey", "is_test")
)
register("kfold_assign", f"SELECT o_orderkey, CAST({_SCR.format(k='o_orderkey', s=0)} % 5 AS INT) AS fold FROM orders")(lambda s, d: selection.folds(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), "o_orderkey"))
register("label_agreement", "WITH c AS (SELECT lang AS a, source AS b, count(*)::DOUBLE AS n FROM documents GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM c), h AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi, -sum(n / t * ln(na / t)) AS ha, -sum(n / t * ln(nb / t)) AS hb FROM t) SELECT round(2 * mi / (ha + hb), 6) AS nmi, round(mi / ha, 6) AS homogeneity FROM h")(
    lambda s, d: selection.label_agreement(s.read.parquet(f"{d}/documents.parquet"), "lang", "source").select(F.round("nmi", 6).alias("nmi"), F.round("homogeneity", 6).alias("homogeneity"))
)
register("crossviews", f"SELECT vec_id, i AS dim1, j AS dim2, round(v0[i + 1], 6) AS x, round(v1[j + 1], 6) AS y FROM {E_} CROSS JOIN (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([2, 3]) AS j)")(
    lambda s, d: selection.crossviews_table(vectors(s, d), [[0, 1], [2, 3]]).select(F.col("sample_id").alias("vec_id"), "dim1", "dim2", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
)


def rounded(out) -> DataFrame:
    return long(out) if isinstance(out, MultiviewFrame) else out


for _name, _make in {
    "cca_scores": lambda mv: embed.CCA(2, regs=0.1).fit_transform(mv),
    "mcca_scores": lambda mv: embed.MCCA(3, regs="lw").fit_transform(mv),
    "imcca_scores": lambda mv: embed.MCCA(2, signal_ranks=[8, 8]).fit_transform(mv),
    "gcca_scores": lambda mv: embed.GCCA(n_components=4).fit_transform(mv),
    "kmcca_scores": lambda mv: embed.KMCCA(2, kernel="rbf", regs=0.5).fit_transform(mv),
    "mvmds_scores": lambda mv: embed.MVMDS(2).fit_transform(mv),
    "group_pca": lambda mv: decomposition.GroupPCA(4).fit_transform(mv),
    "group_ica": lambda mv: decomposition.GroupICA(3).fit_transform(mv),
    "multiview_ica": lambda mv: decomposition.MultiviewICA(3).fit_transform(mv),
    "ajive": lambda mv: decomposition.AJIVE(init_signal_ranks=[4, 4], joint_rank=1, reconsider_joint_components=False, random_state=0).fit_transform(mv),
    "kmeans_fit": lambda mv: cluster.MultiviewKMeans(4, random_state=0).fit_predict(mv),
    "spherical_kmeans_fit": lambda mv: cluster.MultiviewSphericalKMeans(4, random_state=0).fit_predict(mv),
    "spectral": lambda mv: cluster.MultiviewSpectralClustering(4, random_state=0).fit_predict(mv),
    "coreg_spectral": lambda mv: cluster.MultiviewCoRegSpectralClustering(4, random_state=0).fit_predict(mv),
    "deep_cca": lambda mv: deep.DCCA(2, [16, 2], [16, 2], batch_size=200).fit_transform(mv),
    "split_autoencoder": lambda mv: deep.SplitAE(16, 1, 4, batch_size=64).fit_transform(mv),
    "quick_visualize": lambda mv: selection.quick_table(mv),
}.items():
    QUERIES[_name] = lambda s, d, make=_make: rounded(make(vectors(s, d)))


def half_labelled(s, d):
    mv = vectors(s, d)
    y = F.when(F.col("sample_id") % 4 == 0, F.col("y") % 2)
    return MultiviewFrame(mv.df.withColumn("y", y), mv.key, mv.views, "y", mv.dims)


QUERIES["cotraining_classifier"] = lambda s, d: semi.CTClassifier().fit_predict(half_labelled(s, d))
QUERIES["cotraining_regressor"] = lambda s, d: semi.CTRegressor().fit_predict(half_labelled(s, d))
QUERIES["gaussian_mixture"] = lambda s, d: long(datasets.make_gaussian_mixture(s, 1000, [[0, 0], [4, 4]], np.eye(2), "sin", noise=0.1, noise_dims=1))
QUERIES["joint_factor_model"] = lambda s, d: long(datasets.sample_joint_factor_model(s, 500, [6, 4], 2))
QUERIES["train_test_rows"] = lambda s, d: selection.train_test_split(vectors(s, d))[1].df.select("sample_id")


def queries():
    from . import checks  # noqa: F401  registers its queries here

    return dict(QUERIES)


def oracle_sql():
    from . import checks  # noqa: F401

    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views of the embeddings, their regularised canonical correlation, and the scores."""
    return rounded(embed.CCA(2, regs=0.1).fit_transform(vectors(spark, sf_dir)))
