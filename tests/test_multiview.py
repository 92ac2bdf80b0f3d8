"""The multi-view engine against numpy twins, invariants and published values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyview.frame import MultiviewFrame
from polyview.functions import linalg as L
from polyview.operators import cluster, compose, decomposition, deep, embed, selection
from polyview.operators import semi_supervised as semi
from polyview.plans.gram import gram
from polyview.sources import datasets
from polyview.streaming.scoring import RunningGram, score_stream


def frame(spark, xs, y=None):
    rows = [(i, *[list(map(float, x[i])) for x in xs], *([None if y[i] is None or y[i] != y[i] else y[i]] if y is not None else [])) for i in range(len(xs[0]))]
    kind = ("double" if y is not None and any(isinstance(v, float) for v in y if v is not None) else "int")
    schema = "sample_id long, " + ", ".join(f"v{i} array<double>" for i in range(len(xs))) + (f", y {kind}" if y is not None else "")
    return MultiviewFrame(spark.createDataFrame(rows, schema), "sample_id", tuple(f"v{i}" for i in range(len(xs))), "y" if y is not None else None, tuple(x.shape[1] for x in xs))


def local(mv):
    rows = mv.df.orderBy(mv.key).collect()
    return [np.array([r[v] for r in rows]) for v in mv.views]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    z = rng.standard_normal((120, 2))
    return [np.hstack([z @ rng.standard_normal((2, d)) + 0.3 * rng.standard_normal((120, d))]) + 5 for d in (4, 5, 3)]


def test_gram_matches_numpy_at_any_partitioning(spark, data):
    x = np.hstack(data)
    for n in (1, 7):
        mv = frame(spark, data)
        g = gram(MultiviewFrame(mv.df.repartition(n), mv.key, mv.views, None, mv.dims))
        assert np.allclose(g.scatter, (x - x.mean(0)).T @ (x - x.mean(0))) and np.allclose(g.mean, x.mean(0)) and g.n == 120


def test_validation(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], [1.0]), (1, [1.0], [2.0])], "sample_id long, v0 array<double>, v1 array<double>")
    with pytest.raises(ValueError):
        MultiviewFrame(df).checked()
    with pytest.raises(ValueError):
        frame(spark, [np.array([[np.nan]])]).checked()
    with pytest.raises(ValueError):
        frame(spark, [np.ones((2, 1))]).checked(multiview=True)
    with pytest.raises(ValueError):
        L.as_list([1, 2], 3)


def test_compose_round_trips(spark, data):
    mv = frame(spark, data)
    merger = compose.ConcatMerger().fit(mv)
    one = merger.transform(mv)
    assert np.allclose(local(one)[0], np.hstack(data))
    assert all(np.allclose(a, b) for a, b in zip(local(merger.inverse_transform(one)), data, strict=True))
    same = frame(spark, [data[0], data[0] + 2])
    assert np.allclose(local(compose.AverageMerger().fit_transform(same))[0], data[0] + 1)
    with pytest.raises(ValueError):
        compose.AverageMerger().fit(mv)
    sub = compose.RandomSubspaceMethod(3, 0.5, 1).fit_transform(frame(spark, data[:1]))
    assert [x.shape[1] for x in local(sub)] == [2, 2, 2]
    assert local(compose.RandomGaussianProjection(2, 3, random_state=0).fit_transform(frame(spark, data[:1])))[1].shape == (120, 3)
    pcas = compose.ViewTransformer(compose.PCA(2)).fit(mv)
    back = pcas.inverse_transform(pcas.transform(mv))
    assert all(np.abs(a - b).mean() < 0.4 for a, b in zip(local(back), data, strict=True))


def test_view_classifier_and_cross_validation(spark, data):
    y = [int(v) for v in data[0][:, 0] > np.median(data[0][:, 0])]
    mv = frame(spark, data, y)
    assert compose.ViewClassifier(semi.GaussianNB()).fit(mv).score(mv) > 0.7
    assert min(selection.cross_validate(compose.ViewClassifier(semi.GaussianNB()), mv, 3)["test_score"]) > 0.5
    a, b = selection.train_test_split(mv, 0.25, 1)
    assert (a.df.count(), b.df.count()) == (90, 30) and a.df.join(b.df, "sample_id").count() == 0


def test_cca_published_statistics(spark):
    eye = np.eye(3)
    mv = frame(spark, [np.vstack([eye, 2 * eye]), np.vstack([eye[:, ::-1], 0.1 * eye])])
    cca = embed.CCA(3)
    s = cca.fit_transform(mv)
    got = cca.stats(s)
    # Canonical correlation statistics of this input from a numerical package.
    want = {"r": [1, 0.533993, 0.355995], "Wilks": [0, 0.624256, 0.873267], "df1": [9, 4, 1], "df2": [0.150606, 2, 2], "F": [np.inf, 0.132832, 0.290249], "pF": [0, 0.955942, 0.644005], "chisq": [np.inf, 0.706791, 0.542995], "pChisq": [0, 0.950489, 0.461194]}
    for name, values in want.items():
        assert np.allclose(got[name], values, rtol=1e-3, atol=1e-6), (name, got[name])


def test_mcca_invariants(spark, data):
    mv = frame(spark, data)
    for regs, ranks in ((None, None), (0.2, None), ("lw", None), ("oas", None), (None, 2), (0.1, [2, 3, 2])):
        m = embed.MCCA(2, regs=regs, signal_ranks=ranks)
        s = local(m.fit_transform(mv))
        for x, w, mean, score in zip(data, m.loadings_, m.means_, s, strict=True):
            assert np.allclose((x - mean) @ w, score)
        common = sum(s) / m.common_score_norms_
        assert np.allclose((common**2).sum(0), 1)
        assert (common[np.abs(common).argmax(0), range(2)] > 0).all()
    with pytest.raises(ValueError, match="singular"):
        embed.MCCA().fit(frame(spark, [np.array([[1.0, 1, 1], [2, 3, 3], [2, 3, 3]])] * 2))
    full = embed.MCCA(None, multiview_output=True).fit(frame(spark, data[:2]))
    assert full.n_components_ == 9


def test_kernel_mcca_with_linear_kernel_is_mcca(spark, data):
    mv = frame(spark, data)
    a, b = embed.MCCA(2).fit(mv), embed.KMCCA(2, tol=0).fit(mv)
    assert np.allclose(a.evals_[:2], b.evals_[:2], rtol=1e-5)
    assert all(np.allclose(x / np.linalg.norm(x), y / np.linalg.norm(y), atol=1e-4) for x, y in zip(local(a.transform(mv)), local(b.transform(mv)), strict=True))
    r = embed.KMCCA(1, kernel="rbf", kernel_params={"gamma": 0.1}, regs=0.1, tol=0.1).fit(mv)
    assert all(len(p) < 60 for p, _ in r.pivots_) and abs(r.canon_corrs(r.transform(mv))[0, 0, 1]) > 0.8


def test_gcca_and_elbows(spark, data):
    g = embed.GCCA(n_components=2).fit(frame(spark, data))
    s = local(g.transform(frame(spark, data)))
    assert all(x.shape == (120, 2) for x in s) and abs(np.corrcoef(s[0][:, 0], s[1][:, 0])[0, 1]) > 0.7
    assert embed.select_dimension([10, 9, 3, 2, 1], n_elbows=1)[0] == [2]
    with pytest.raises(IndexError):
        embed.select_dimension([1, 2], threshold=5)


def test_mvmds_matches_dense_iteration(spark, data):
    got = np.array([r.mds for r in embed.MVMDS(2).fit_transform(frame(spark, data)).orderBy("sample_id").collect()])
    assert np.allclose(got.T @ got, np.eye(2), atol=1e-6)
    bs = [(x - x.mean(0)) @ (x - x.mean(0)).T for x in data]
    q = np.linalg.eigh(sum(bs))[1][:, -1]
    for _ in range(15):
        q = sum(b @ q / (q @ b @ q) for b in bs)
        q /= np.linalg.norm(q)
    assert abs(q @ got[:, 0]) > 0.98


def test_group_pca(spark, data):
    mv = frame(spark, data)
    p = decomposition.GroupPCA(2, multiview_output=False).fit(mv)
    x = np.hstack(data)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = local(p.transform(mv))[0]
    own = decomposition.GroupPCA(12, "auto", multiview_output=False).fit(mv)
    assert np.allclose(np.abs(np.linalg.svd(got)[1]), s[:2], rtol=0.02) and own.components_.shape == (12, 12)
    back = local(own.inverse_transform(own.transform(mv)))
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(back, data, strict=True))
    white = local(decomposition.GroupPCA(2, multiview_output=False, whiten=True).fit_transform(mv))[0]
    assert np.allclose(white.std(axis=0, ddof=1), 1)


def amari(a):
    a = np.abs(a)
    return ((a / a.max(0)).sum() + (a / a.max(1, keepdims=True)).sum() - 2 * len(a)) / (2 * len(a) * (len(a) - 1))


def test_independent_components(spark):
    rng = np.random.default_rng(0)
    s = rng.laplace(size=(1500, 3))
    mixes = [rng.standard_normal((3, 4)), rng.standard_normal((3, 4))]
    xs = [(s + 0.01 * rng.standard_normal(s.shape)) @ m for m in mixes]
    mv = frame(spark, xs)
    for model in (decomposition.GroupICA(3), decomposition.MultiviewICA(3, noise=0.1)):
        model.fit(mv)
        for c, m in zip(model.individual_components_, mixes, strict=True):
            assert amari(m @ c) < 0.1, type(model)


def test_ajive_ranks(spark):
    rng = np.random.default_rng(12)
    joint = rng.standard_normal((60, 1))
    x = 8 * joint @ rng.standard_normal((1, 30)) + 6 * rng.standard_normal((60, 2)) @ rng.standard_normal((2, 30)) + 0.5 * rng.standard_normal((60, 30))
    y = 8 * joint @ rng.standard_normal((1, 20)) + 6 * rng.standard_normal((60, 1)) @ rng.standard_normal((1, 20)) + 0.5 * rng.standard_normal((60, 20))
    mv = frame(spark, [x, y])
    a = decomposition.AJIVE(init_signal_ranks=[3, 2], random_state=0, n_wedin_samples=200, n_randdir_samples=200).fit(mv)
    assert a.joint_rank_ == 1 and a.individual_ranks_ == [2, 1]
    j, i = local(a.transform(mv)), local(a.individual(mv))
    assert all(np.linalg.matrix_rank(m, tol=1e-6) == 1 for m in j)
    assert all(np.linalg.norm(d - d.mean(0) - p - q) < 0.4 * np.linalg.norm(d - d.mean(0)) for d, p, q in zip([x, y], j, i, strict=True))


def test_kmeans(spark):
    xs = np.array([[-1.0, -1], [-1, -1], [-1, -1], [1, 0.6], [1, 1]])
    km = cluster.MultiviewKMeans(2)
    km.centroids_ = [np.array([[0.0, 0], [1, 1]])] * 2
    got = [r.cluster for r in km.predict(frame(spark, [xs, xs])).orderBy("sample_id").collect()]
    assert got == [0, 0, 0, 1, 1]
    rng = np.random.default_rng(1)
    centers = np.array([[5, 0, 0], [0, 5, 0], [0, 0, 5]])
    y = np.repeat([0, 1, 2], 40)
    views = [centers[y] + rng.standard_normal((120, 3)) * 0.4 for _ in range(2)]
    for model in (cluster.MultiviewKMeans(3, random_state=0), cluster.MultiviewSphericalKMeans(3, random_state=0), cluster.MultiviewSpectralClustering(3, random_state=0, max_iter=3), cluster.MultiviewCoRegSpectralClustering(3, random_state=0, max_iter=3)):
        mv = frame(spark, views, [int(v) for v in y])
        out = model.fit_predict(mv).select("sample_id", "cluster").join(mv.df.select("sample_id", "y"), "sample_id")
        assert selection.label_agreement(out, "y", "cluster").first().nmi > 0.9, type(model)


def test_co_training(spark):
    rng = np.random.default_rng(3)
    y = np.arange(400) % 2
    views = [rng.standard_normal((400, 3)) + 2 * y[:, None] for _ in range(2)]
    part = [int(v) if i < 20 else None for i, v in enumerate(y)]
    ct = semi.CTClassifier(num_iter=10).fit(frame(spark, views, part))
    out = ct.predict(frame(spark, views, [int(v) for v in y]))
    assert selection.accuracy(out, "y", "prediction") > 0.95
    t = [float(v) for v in views[0].sum(1)]
    reg = semi.CTRegressor(3, num_iter=5).fit(frame(spark, [views[0], views[0]], [v if i < 60 else None for i, v in enumerate(t)]))
    got = reg.predict(frame(spark, [views[0], views[0]], t)).select(F.corr("y", "prediction")).first()[0]
    assert got > 0.9


def test_deep_models(spark):
    rng = np.random.default_rng(4)
    h1, h2 = rng.standard_normal((30, 3)), rng.standard_normal((30, 3))
    loss, g1, _ = deep.cca_loss(h1, h2, 2)
    e = np.zeros_like(h1)
    e[4, 1] = 1e-5
    assert np.isclose((deep.cca_loss(h1 + e, h2, 2)[0] - deep.cca_loss(h1 - e, h2, 2)[0]) / 2e-5, g1[4, 1], rtol=1e-3)
    z = rng.standard_normal((200, 2))
    views = [np.tanh(z @ rng.standard_normal((2, 6))), np.sin(z @ rng.standard_normal((2, 5)))]
    mv = frame(spark, views)
    d = deep.DCCA(2, [16, 2], [16, 2], epoch_num=5, batch_size=100, learning_rate=1e-2).fit(mv)
    assert local(d.transform(mv))[0].shape == (200, 2) and d.loss_ < -1
    s = deep.SplitAE(16, 1, 4, training_epochs=5, learning_rate=0.01).fit(mv)
    assert [x.shape[1] for x in local(s.transform(mv))] == [4, 6, 5] and s.loss_ < 0.8


def test_simulators_and_plot_tables(spark):
    mv = datasets.make_gaussian_mixture(spark, 200, [[0, 0], [6, 6]], np.eye(2), "poly", class_probs=[0.3, 0.7])
    x, y = local(mv)
    assert np.allclose(x**2, y) and mv.df.where("y = 0").count() == 60
    f = datasets.sample_joint_factor_model(spark, 100, [10, 5], 2, m=50)
    values = np.linalg.svd(local(f)[0])[1]
    assert values[1] > 5 * values[2]
    assert selection.crossviews_table(mv).count() == 800 and selection.quick_table(mv).count() == 200
    with pytest.raises(ValueError):
        selection.crossviews_table(mv, [[0], [9]])


def test_streaming(spark, data, tmp_path):
    mv = frame(spark, data)
    mv.df.repartition(3).write.parquet(str(tmp_path / "in"))
    model = embed.MCCA(1).fit(mv)
    stream = spark.readStream.schema(mv.df.schema).parquet(str(tmp_path / "in"))
    q = score_stream(model, stream, mv).writeStream.format("memory").queryName("scores").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scores").count() == 120
    run = RunningGram(mv)
    for k in range(3):
        run.update(mv.df.where(F.col("sample_id") % 3 == k))
    assert np.allclose(run.gram.scatter, gram(mv).scatter)


@pytest.mark.parametrize("name", ["group_ica", "multiview_ica", "kmeans_fit", "spherical_kmeans_fit", "spectral", "coreg_spectral", "deep_cca", "split_autoencoder", "cotraining_classifier", "cotraining_regressor", "kmcca_scores"])
def test_registered_estimators_run_the_whole_job(monkeypatch, name):
    from polyview import queries as q

    class Made(Exception):
        pass

    def init(self, *args, **given):
        raise Made(set(given))

    classes = [q.decomposition.GroupICA, q.decomposition.MultiviewICA, q.cluster.MultiviewKMeans, q.cluster.MultiviewSphericalKMeans, q.cluster.MultiviewSpectralClustering, q.cluster.MultiviewCoRegSpectralClustering, q.deep.DCCA, q.deep.SplitAE, q.semi.CTClassifier, q.semi.CTRegressor, q.embed.KMCCA]
    for c in classes:
        monkeypatch.setattr(c, "__init__", init)
    monkeypatch.setattr(q, "vectors", lambda s, d: None)
    monkeypatch.setattr(q, "half_labelled", lambda s, d: None)
    with pytest.raises(Made) as made:
        q.QUERIES[name](None, None)
    assert not made.value.args[0] & {"max_iter", "n_init", "num_iter", "epoch_num", "training_epochs", "unlabeled_pool_size", "tol", "max_rank", "patience"}


class NearestMeans:
    """A plain classifier for co-training: the nearer class mean, with the share of its distance as probability."""

    def fit(self, x, y):
        self.classes = sorted(set(y.tolist()))
        self.means = np.array([x[y == c].mean(0) for c in self.classes])
        return self

    def predict_proba(self, x):
        d = np.exp(-((x[:, None] - self.means[None]) ** 2).sum(-1))
        return (d + 1e-12) / (d + 1e-12).sum(1, keepdims=True)


def test_co_training_with_other_estimators(spark):
    spark.sparkContext.addPyFile(__file__)  # workers import the classifier from here
    rng = np.random.default_rng(3)
    y = np.arange(300) % 2
    views = [rng.standard_normal((300, 3)) + 2 * y[:, None] for _ in range(2)]
    part = frame(spark, views, [int(v) if i < 20 else None for i, v in enumerate(y)])
    full = frame(spark, views, [int(v) for v in y])
    for model in (semi.CTClassifier(num_iter=5, estimator1=NearestMeans()), semi.CTClassifier(num_iter=5, estimator2=NearestMeans())):
        model.fit(part)
        assert selection.accuracy(model.predict(full), "y", "prediction") > 0.9
        assert all(np.isclose(sum(r.proba), 1) for r in model.predict_proba(full).collect())
    with pytest.raises(AttributeError):
        semi.CTClassifier(estimator1=object())
    with pytest.raises(ValueError):
        semi.CTClassifier(estimator1=NearestMeans(), max_labelled=5).fit(part)
    t = [float(v) for v in views[0].sum(1)]
    reg = semi.CTRegressor((3, 5), num_iter=2).fit(frame(spark, views[:1] * 2, [v if i < 60 else None for i, v in enumerate(t)]))
    assert reg.predict(frame(spark, views[:1] * 2, t)).select(F.corr("y", "prediction")).first()[0] > 0.9


def test_moments_of_large_means(spark):
    x = np.array([[1e9 + v] for v in (0.0, 1, 2, 10, 11, 12)])
    nb = semi.GaussianNB().fit(frame(spark, [x], [0, 0, 0, 1, 1, 1]))
    assert np.allclose(nb.theta_[:, 0] - 1e9, [1, 11]) and np.allclose(nb.var_, 2 / 3, rtol=1e-6)


def test_cross_validation_options(spark):
    rng = np.random.default_rng(0)
    y = np.arange(60) % 2
    mv = frame(spark, [rng.standard_normal((60, 2)) + 3 * y[:, None]], [int(v) for v in y])
    out = selection.cross_validate(compose.ViewClassifier(semi.GaussianNB()), mv, 3, scoring={"own": lambda e, m: e.score(m), "rows": lambda e, m: m.df.count()}, return_train_score=True, return_estimator=True)
    assert sum(out["test_rows"]) == 60 and sum(out["train_rows"]) == 120 and min(out["train_own"]) > 0.9 and len(out["estimator"]) == 3
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 2.0)], "a double, b double")
    assert selection.mean_squared_error(df, "a", "b") == 2.0


def test_gcca_takes_in_rows_by_parts(spark, data):
    mv = frame(spark, data)
    whole = embed.GCCA(n_components=2).fit(mv)
    parts = [frame(spark, [x[s] for x in data]) for s in (slice(0, 37), slice(37, None))]
    step = embed.GCCA(n_components=2).partial_fit(parts[0], multiview_step=False)
    assert not hasattr(step, "projections_")
    step.partial_fit(parts[1])
    for a, b in zip(whole.projections_, step.projections_, strict=True):
        assert np.allclose(np.abs(a), np.abs(b), atol=1e-8)


def test_mvmds_on_distances(spark, data):
    xs = [x[:40] for x in data[:2]]
    plain = local_rows(embed.MVMDS(2).fit_transform(frame(spark, xs)), "mds")
    far = [np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) for x in xs]
    given = local_rows(embed.MVMDS(2, dissimilarity="precomputed").fit_transform(frame(spark, far)), "mds")
    assert np.allclose(np.abs(plain), np.abs(given), atol=1e-6)
    with pytest.raises(ValueError):
        embed.MVMDS(2, dissimilarity="precomputed").fit_transform(frame(spark, xs))


def local_rows(df, column):
    return np.array([r[column] for r in df.orderBy("sample_id").collect()])


def test_ajive_parts_add_up(spark):
    rng = np.random.default_rng(2)
    u = np.linalg.qr(rng.standard_normal((80, 3)))[0] * 20
    xs = [np.outer(u[:, 0], rng.standard_normal(5)) + np.outer(u[:, i + 1], rng.standard_normal(5)) + 3 for i in range(2)]
    mv = frame(spark, xs)
    model = decomposition.AJIVE([2, 2], 1, [1, 1], random_state=0).fit(mv)
    assert model.joint_rank_ == 1
    back = local(model.inverse_transform(model.transform(mv), model.individual(mv)))
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(back, xs, strict=True))


def test_ica_starts(spark):
    rng = np.random.default_rng(5)
    s = rng.laplace(size=(400, 2))
    xs = [s @ rng.standard_normal((2, 2)) + 0.01 * rng.standard_normal((400, 2)) for _ in range(2)]
    mv = frame(spark, xs)
    found = [decomposition.MultiviewICA(2, init=i, multiview_output=False).fit(mv) for i in ("permica", "groupica", [np.eye(2)] * 2)]
    for model in found[:2]:
        c = np.abs(np.corrcoef(local(model.transform(mv))[0].T, s.T)[:2, 2:])
        assert (c.max(axis=1) > 0.95).all()
    with pytest.raises(ValueError):
        decomposition.MultiviewICA(2, init="other")
    with pytest.raises(ValueError):
        decomposition.MultiviewICA(2, init=[np.eye(3)] * 2).fit(mv)


def test_single_views_and_model_files(spark, data, tmp_path):
    from polyview.sources import models

    mv = frame(spark, data)
    model = embed.MCCA(2).fit(mv)
    models.save_model(spark, model, str(tmp_path / "m"))
    again = models.load_model(spark, str(tmp_path / "m"))
    one = MultiviewFrame(mv.df.select("sample_id", F.col("v1").alias("v0")), "sample_id", ("v0",), None, mv.dims[1:2])
    scores = again.transform_view(one, 1)
    assert np.allclose(local(scores)[0], local(model.transform(mv))[1])
    back = local(again.inverse_transform_view(scores, 1))[0]
    assert np.isclose(again.score_view(one, 1), ((back - data[1]) ** 2).sum()) and np.isclose(again.score_view(one, 1), model.score(mv)[1])


def test_cca_loss_of_all_correlations():
    rng = np.random.default_rng(4)
    h1, h2 = rng.standard_normal((30, 3)), rng.standard_normal((30, 3))
    _, g1, g2 = deep.cca_loss(h1, h2)
    for side, g in ((0, g1), (1, g2)):
        e = np.zeros_like(h1)
        e[4, 1] = 1e-5
        at = lambda sign: deep.cca_loss(*(h + sign * e * (i == side) for i, h in enumerate((h1, h2))))[0]
        assert np.isclose((at(1) - at(-1)) / 2e-5, g[4, 1], rtol=1e-3)


def test_frames_too_large_for_the_driver_are_cached(spark, data, monkeypatch):
    from polyview import frame as module

    mv = frame(spark, data[:2])
    small = cluster.MultiviewKMeans(2, random_state=1).fit(mv)
    monkeypatch.setattr(module, "LOCAL_BYTES", 0)
    large = cluster.MultiviewKMeans(2, random_state=1).fit(mv)
    assert all(np.allclose(a, b) for a, b in zip(small.centroids_, large.centroids_, strict=True))
    with mv.checked().pinned() as held:
        assert held.local is None and held.df.is_cached
    d = deep.SplitAE(8, 1, 2, training_epochs=2).fit(mv)
    monkeypatch.undo()
    assert np.isclose(d.loss_, deep.SplitAE(8, 1, 2, training_epochs=2).fit(mv).loss_)


def test_simulators_return_what_they_drew(spark):
    mv, latent = datasets.make_gaussian_mixture(spark, 50, [[0, 0]], np.eye(2), noise=0.01, return_latents=True)
    assert np.abs(local(mv)[0] - local(latent)[0]).max() < 1
    mv, (u, s, ws) = datasets.sample_joint_factor_model(spark, 60, [5, 4], 2, noise_std=1e-6, return_decomp=True)
    for x, w in zip(local(mv), ws, strict=True):
        assert np.allclose(x, local(u)[0] * s @ w.T, atol=1e-4)


@pytest.mark.parametrize("stratify", [None, "g"])
def test_split_flags_against_an_ordered_list(spark, stratify):
    rows = [(None if i == 7 else i * 3, None if i % 5 == 4 else i % 5) for i in range(1003)]
    found = selection.split_flags(spark.createDataFrame(rows, "k bigint, g bigint"), "k", 0.3, 2, stratify).collect()
    assert len(found) == len(rows)
    for g in {r[1] for r in rows} if stratify else [...]:
        of = [r for r in found if g is ... or r["g"] == g]
        order = sorted(of, key=lambda r: (r["k"] is not None, ((r["k"] or 0) * 7919 + 2 * 104729) % 10007, r["k"] or 0))
        want = math.ceil(0.3 * len(of))
        assert [r["is_test"] for r in order] == [i < want for i in range(len(of))]


def dense_spectral(xs, k, affinity, rounds, weight=None):
    """Leading eigenvectors of both spectral methods from whole n x n matrices; with a weight, co-regularised."""

    def kernel(x):
        d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
        gamma = 1 / (2 * np.median(np.sqrt(d2)) ** 2)
        if affinity == "nearest_neighbors":
            out = np.zeros_like(d2)
            np.put_along_axis(out, np.argsort(d2, axis=1, kind="stable")[:, :10], 1.0, axis=1)
            return out
        return np.exp(-gamma * d2) if affinity == "rbf" else (gamma * x @ x.T + 1) ** 3

    def scaled(s):
        d = np.sqrt(np.abs(s.sum(axis=1)))
        return s / d[:, None] / d[None]

    def top(a):
        vals, vecs = np.linalg.eigh((a + a.T) / 2)
        return vecs[:, np.argsort(-np.abs(vals))[:k]]

    kernels = [kernel(x) for x in xs]
    us = [top(scaled(s)) for s in kernels]
    for _ in range(rounds):
        if weight is None:
            projected = [s @ sum(u @ u.T for w, u in enumerate(us) if w != v) for v, s in enumerate(kernels)]
            us = [top(scaled((p + p.T) / 2)) for p in projected]
        else:
            for v in [*range(1, len(us)), 0]:
                us[v] = top(scaled(kernels[v]) + weight * sum(u @ u.T for w, u in enumerate(us) if w != v))
    return us


@pytest.mark.parametrize("affinity", ["rbf", "poly", "nearest_neighbors"])
@pytest.mark.parametrize("weight", [None, 2])
@pytest.mark.parametrize("spread", [False, True])
def test_spectral_embeddings_equal_dense_ones(spark, monkeypatch, affinity, weight, spread):
    from polyview.plans import pairs

    rng = np.random.default_rng(11)
    y = np.arange(301) % 3
    xs = [rng.standard_normal((301, d)) * 0.7 + np.eye(3, d)[y] * 4 for d in (5, 4, 3)]
    if spread:
        monkeypatch.setattr(pairs, "SMALL", 0)
        monkeypatch.setattr(pairs, "FEW", 50)  # the median takes several narrowings
    aff = pairs.Affinities(spark, xs, affinity)
    model = cluster.MultiviewSpectralClustering(3, max_iter=4) if weight is None else cluster.MultiviewCoRegSpectralClustering(3, max_iter=5)
    got = model.embed(aff)
    aff.close()
    for a, b in zip(got, dense_spectral(xs, 3, affinity, 4, weight), strict=True):
        assert np.allclose(a @ a.T, b @ b.T, atol=1e-7)
    if affinity != "nearest_neighbors":
        assert np.allclose(aff.gammas, [1 / (2 * np.median(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))) ** 2) for x in xs])


@pytest.mark.parametrize("make", [cluster.MultiviewSpectralClustering, cluster.MultiviewCoRegSpectralClustering])
def test_spectral_takes_more_rows_than_a_matrix_fits(spark, make):
    rng = np.random.default_rng(12)
    y = np.arange(6001) % 3
    mv = frame(spark, [rng.standard_normal((6001, 3)) * 0.5 + np.eye(3)[y] * 6 for _ in range(2)], [int(v) for v in y])
    out = make(3, random_state=0, max_iter=2).fit_predict(mv).join(mv.df.select("sample_id", "y"), "sample_id")
    assert out.count() == 6001 and selection.label_agreement(out, "y", "cluster").first().nmi > 0.99


def counted_pairs(monkeypatch):
    """The list that gets the number of pairs in every block that is computed from now on."""
    from polyview.plans import pairs

    sizes, of = [], pairs.blocks

    def blocks(*args, **more):
        for b in of(*args, **more):
            sizes.append(b[2].size)
            yield b

    monkeypatch.setattr(pairs, "blocks", blocks)
    return sizes


def test_affinity_passes_compute_a_pair_once_for_both_rows(monkeypatch):
    from polyview.plans import pairs

    rng, n = np.random.default_rng(13), 2001
    xs = [rng.standard_normal((n, 4)), np.repeat(rng.standard_normal((3, 2)), n // 3, axis=0)]  # the second has many copies
    sizes = counted_pairs(monkeypatch)
    aff = pairs.Affinities(None, xs)
    for x, gamma in zip(xs, aff.gammas, strict=True):
        d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
        assert np.isclose(gamma, 1 / (2 * np.median(np.sqrt(d2)) ** 2))
    del sizes[:]
    for width in (4, pairs.NARROW + 1):
        b = rng.standard_normal((n, width))
        got = aff.times({0: b})[0]
        assert np.allclose(got, np.exp(-aff.gammas[0] * ((xs[0][:, None] - xs[0][None]) ** 2).sum(-1)) @ b)
        assert (sum(sizes) < 0.6 * n * n) == (width <= pairs.NARROW)
        del sizes[:]


def test_affinity_tiles_in_several_jobs(spark, monkeypatch):
    from polyview.plans import pairs

    monkeypatch.setattr(pairs, "SMALL", 0)
    monkeypatch.setattr(pairs, "HELD", 1)
    rng, n = np.random.default_rng(14), 1001
    xs, b = [rng.standard_normal((n, 3)), rng.standard_normal((n, 2))], rng.standard_normal((n, 3))
    for affinity, kernel in (("rbf", lambda x: np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))), ("poly", lambda x: (0.3 * x @ x.T + 1) ** 3)):
        aff = pairs.Affinities(spark, xs, affinity, 0.3)
        got = aff.times({0: b, 1: b[:, :2]})
        aff.close()
        assert np.allclose(got[0], kernel(aff.xs[0]) @ b) and np.allclose(got[1], kernel(aff.xs[1]) @ b[:, :2])


@pytest.mark.parametrize("make", [cluster.MultiviewSpectralClustering])
def test_spectral_rounds_compute_half_the_pairs(spark, monkeypatch, make):
    rng, n = np.random.default_rng(15), 1500
    xs = [rng.standard_normal((n, 3)) for _ in range(2)]
    sizes = counted_pairs(monkeypatch)
    spent = []
    for rounds in (3, 8):
        make(3, random_state=0, max_iter=rounds).embed(cluster.Affinities(spark, xs))
        spent.append(sum(sizes))
        del sizes[:]
    assert 0 < spent[1] - spent[0] < 5 * 2 * 0.6 * n * n  # five rounds of both views


def test_coreg_rounds_compute_half_the_pairs(spark, monkeypatch):
    from polyview.plans import pairs

    rng, n = np.random.default_rng(16), 1500
    xs = [rng.standard_normal((n, 3)) for _ in range(2)]
    sizes, passes, of = counted_pairs(monkeypatch), [], pairs.products
    monkeypatch.setattr(pairs, "products", lambda views, asked, *args: passes.append(asked[0][3].shape[1]) or of(views, asked, *args))
    spent = []
    for rounds in (1, 6):
        cluster.MultiviewCoRegSpectralClustering(3, random_state=0, max_iter=rounds).embed(cluster.Affinities(spark, xs))
        spent.append((sum(sizes), len(passes)))
        del sizes[:], passes[:]
    more = spent[1][1] - spent[0][1]
    assert more >= 10 and spent[1][0] - spent[0][0] < more * 0.6 * n * n  # five rounds of both views


@pytest.mark.parametrize("name", ["spectral_clusters", "coreg_clusters"])
def test_cluster_counts_use_the_halved_passes(spark, monkeypatch, tmp_path, name):
    from polyview import checks, queries  # noqa: F401  checks registers its queries
    from polyview.plans import pairs

    rng, n = np.random.default_rng(17), 1200
    rows = [(i, [float(x) for x in rng.standard_normal(64) + 5 * (i % 4)], i % 4) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    sizes, narrow, of = counted_pairs(monkeypatch), [], pairs.products

    def products(views, asked, *args):
        before = sum(sizes)
        out = of(views, asked, *args)
        if sum(a[3].shape[1] for a in asked) <= pairs.NARROW:
            narrow.append((sum(sizes) - before) / len(asked))
        return out

    monkeypatch.setattr(pairs, "products", products)
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == [(n, 4)]
    assert narrow and max(narrow) < 0.65 * n * n


def most_columns(make) -> float:
    """How many columns, of a number a row, an embedding of two views holds at once; affinities of rank 400 stand in for passes over all pairs."""
    import tracemalloc

    n, rng = 30_000, np.random.default_rng(18)

    class LowRank:
        near, xs = None, [np.exp(rng.standard_normal((n, 400)) * 0.99 ** np.arange(400)) for _ in range(2)]

        def __init__(self):
            self.n = n

        def times(self, blocks):
            return {v: self.xs[v] @ (self.xs[v].T @ b) for v, b in blocks.items()}

        symmetric = times

    affinities = LowRank()
    tracemalloc.start()
    us = make(4, random_state=0, max_iter=3).embed(affinities)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for u in us:
        assert np.allclose(u.T @ u, np.eye(4), atol=1e-9)
    return peak / (8 * n)


def test_coreg_holds_bases_once():
    assert most_columns(cluster.MultiviewCoRegSpectralClustering) < 420


def test_spectral_holds_the_bases_of_one_view():
    assert most_columns(cluster.MultiviewSpectralClustering) < 340
