import warnings

import numpy as np
import pytest

from kinfold.operators import graph, hdp, mixture, posterior, prep, viewdata
from kinfold.operators.patterns import compress, of_matrix
from tests.fixtures import SCHEMA, planted


def two_classes(n=100, seed=0):
    rng = np.random.default_rng(seed)
    truth = np.arange(n) % 2
    p = np.where(truth[:, None] == 0, [0.8, 0.7, 0.1, 0.1], [0.1, 0.1, 0.7, 0.8])
    return (rng.random((n, 4)) < p).astype(int), truth


def assigned(p, m, x):
    r = x @ m.terms()[1].T + m.terms()[2] + m.terms()[0][0]
    return r.argmax(1)


def test_bic():
    assert mixture.bic(-100, 2, 4, 50) == pytest.approx(200 + 9 * np.log(50))


def test_empirical_bayes():
    a, b = mixture.empirical_bayes([0.5, 0.1, 0.0])
    assert list(zip(a, b)) == [(6, 6), (2, 10), (1, 11)]


def test_em_recovers_planted_classes():
    x, truth = two_classes()
    p = of_matrix(x)
    m = mixture.fit(p, 2, seed=1)
    assert graph.adjusted_rand(truth, assigned(p, m, x)) > 0.5
    assert m.converged and m.pi.sum() == pytest.approx(1)
    order = m.pi * m.theta.sum(1)
    assert (np.diff(order) <= 1e-12).all()


def test_em_over_specified_and_stopped_early():
    x, _ = two_classes(60)
    for k, it in ((10, 200), (3, 1)):
        m = mixture.fit(of_matrix(x), k, max_iter=it, n_init=1)
        assert np.isfinite([m.log_likelihood, m.bic]).all() and np.isfinite(m.theta).all()


def test_em_selects_two():
    x, _ = two_classes(200, 3)
    assert mixture.select_k(of_matrix(x), range(2, 5), n_init=3).best_k == 2


def test_em_errors():
    x, _ = two_classes(10)
    for k in (0, 11):
        with pytest.raises(ValueError):
            mixture.fit(of_matrix(x), k)
    with pytest.raises(ValueError):
        mixture.fit(of_matrix(x), 2, prior="other")
    with pytest.raises(ValueError):
        of_matrix(np.zeros((0, 3)))
    with pytest.raises(ValueError):
        mixture.select_k(of_matrix(x), [])


def test_shrinkage():
    rng = np.random.default_rng(5)
    x = (rng.random((200, 20)) < 0.02).astype(int)
    means = x.mean(0)
    gap = {k: np.abs(mixture.fit(of_matrix(x), 3, prior=k, n_init=2).theta - means).mean() for k in mixture.PRIORS}
    assert gap["empirical_bayes"] < gap["flat"]


def test_distributed_pass_equals_local(spark):
    ev = spark.createDataFrame(planted(), SCHEMA)
    trans = prep.transactions(ev, keys=("group",))
    local, far = compress(trans, "group"), compress(trans, "group", max_local=2)
    assert far.x is None
    rng = np.random.default_rng(0)
    theta = rng.uniform(0.1, 0.9, (3, len(local.items)))
    terms = np.log(rng.dirichlet(np.ones(3), 2)), np.log(theta) - np.log1p(-theta), np.log1p(-theta).sum(1)
    a, b = local.expect(*terms), far.expect(*terms)
    assert a.total == pytest.approx(b.total) and np.allclose(a.by_item, b.by_item) and np.allclose(a.by_group, b.by_group)


def test_hdp_planted(spark):
    ev = spark.createDataFrame(planted(), SCHEMA)
    found = hdp.hdp_clustering(ev, k_max=8, n_init=3, seed=1)
    kinds = set(hdp.categorize(found)["category"])
    assert {"universal", "group_a_only", "group_b_only"} <= kinds
    assert found.model.theta.max() > 0.6 and np.allclose(found.model.pi_mean.sum(1), 1)
    assert found.assignments.count() == 200
    assert len(viewdata.hdp_butterfly(found)) >= 3 and len(viewdata.hdp_sharing(found)) > 0
    assert "effective K" in hdp.hdp_summary(found)


def test_hdp_errors(spark):
    ev = spark.createDataFrame([*planted(), (999, "S1", "C", 2010)], SCHEMA)
    with pytest.raises(ValueError, match="C"):
        hdp.hdp_clustering(ev, k_max=3, n_init=1)
    with pytest.raises(ValueError):
        hdp.hdp_clustering(ev, group_by="nothing")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        hdp.fit(of_matrix(two_classes(6)[0]), k_max=10, n_init=1, max_iter=3)
    assert seen


def test_effective_k():
    assert hdp.effective_k([0.5, 0.3, 0.2]) == 3 and hdp.effective_k([0.96, 0.04]) == 1


@pytest.mark.parametrize("fit", [posterior.fit_gibbs, posterior.fit_vi])
def test_posteriors(fit):
    x, truth = two_classes(60)
    post = fit(of_matrix(x), 2, n_samples=80)
    assert post.theta.shape[1:] == (2, 4) and np.allclose(post.pi.sum(1), 1)
    assert (post.pi_ci[:, 0] <= post.pi_ci[:, 1]).all() and (post.theta_ci[..., 0] <= post.theta_ci[..., 1]).all()
    assert np.allclose(post.responsibilities.sum(1), 1)
    assert len(post.table()) == 8 and "class 1" in posterior.posterior_summary(post)
    with pytest.raises(ValueError):
        fit(of_matrix(x), 0)


def test_clusterings_compared(spark):
    ev = spark.createDataFrame(planted(), SCHEMA)
    a, b = (mixture.bernoulli_clustering(ev, [2], group=g, n_init=2) for g in "AB")
    shared, own = mixture.compare_clusterings(a, b)
    assert list(shared["item"]) == ["S1", "S2"] and set(own["group"]) == {"A", "B"}
    assert "class 1" in mixture.clustering_summary(a)
    assert len(viewdata.class_probabilities(a)) and viewdata.bic_elbow(a.selection)["best"].sum() == 1


def test_chart_data(spark):
    ev = spark.createDataFrame(planted(), SCHEMA)
    trans = prep.transactions(ev)
    best, sizes = viewdata.upset(trans)
    assert best.first().n == 80 and sizes.count() == 6
    square, marked = viewdata.phi_heatmap(trans)
    assert square.loc["S1", "S2"] == pytest.approx(1.0) and not marked.to_numpy().diagonal().any()
    assert viewdata.item_prevalence(ev).first().overall == pytest.approx(40.0)
    assert viewdata.record_heatmap(trans, 10).count() == 10
    assert list(viewdata.min_max([1, 1], 0, 10)) == [5, 5]


def test_restarts_and_sizes_share_passes(monkeypatch):
    from kinfold.operators import patterns

    seen, plain = [], patterns.sums
    monkeypatch.setattr(patterns, "sums", lambda *a: seen.append(1) or plain(*a))
    x, _ = two_classes(60)
    mixture.select_k(of_matrix(x), range(2, 6), n_init=2, max_iter=5, tol=0.0)
    assert len(seen) <= 6


@pytest.mark.parametrize("fit", [lambda ev: mixture.bernoulli_clustering(ev, [2], n_init=2), lambda ev: hdp.hdp_clustering(ev, k_max=4, n_init=1)])
def test_models_read_their_events_once(spark, fit):
    count = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            count.add(len(f))
            yield f

    ev = spark.createDataFrame(planted(), SCHEMA).mapInPandas(counted, SCHEMA)
    assert fit(ev).assignments.count() == 200
    assert count.value == 400
