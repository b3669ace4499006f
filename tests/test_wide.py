import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import hdp, mixture, wide
from kinfold.operators.patterns import of_matrix
from kinfold.plans import catalog
from kinfold.sources import io

DOCS = "doc_id long, text string, lang string"


def written(spark, path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def mostly_english(n=160, few=16):
    """Two or three of six words in each document; a tenth are Spanish, and all its words are rare or short."""
    rng = np.random.default_rng(0)
    words = {"en": "house river stone cloud paper green".split(), "es": "sol mar uno dos rojo año".split()}
    rows = [(i, " ".join(rng.choice(words[g], 4, replace=False)), g) for i, g in enumerate(["en"] * n + ["es"] * few)]
    return [*rows, (n + few, "house unseen", "en")], words


@pytest.fixture(scope="module")
def few_spanish(spark, tmp_path_factory):
    rows, words = mostly_english()
    return written(spark, tmp_path_factory.mktemp("few") / "sf", rows), words


def records(n=60, seed=0):
    """Records of five planted and many rare items, some of them in exactly the same records."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        side = i % 2
        items = {f"{'ab'[side]}{j}" for j in range(6) if rng.random() < 0.7} | {f"c{j}" for j in range(4) if rng.random() < 0.4}
        items |= {f"own{i}", f"too{i}"} if i % 3 else {"twin1", "twin2"}
        rows.append((i, ["x", "y", "z"][i % 3 if side else 0], sorted(items)))
    return rows


def dense(spark, rows):
    """Items, 0/1 matrix, groups and the seeds that gather() gives to items."""
    items = sorted({w for r in rows for w in r[2]})
    x = np.array([[w in r[2] for w in items] for r in rows], float)
    hashes = dict(spark.createDataFrame([(w,) for w in items], "i string").select("i", F.xxhash64("i")).collect())
    first: dict = {}
    seeds = np.array([hashes[first.setdefault(c.tobytes(), w)] for w, c in zip(items, x.T)], np.int64).view(np.uint64)
    return items, x, np.array([ord(r[1]) - ord("x") for r in rows]), seeds


class Fixed:
    """Gives run_cavi the random numbers of the wide fit."""

    def __init__(self, seeds):
        self.seeds = seeds

    def random(self, shape):
        return np.array([wide.uniform(self.seeds, 0, 0, k) for k in range(shape[0])])

    def dirichlet(self, alpha, size):
        return np.random.default_rng([0, 0]).dirichlet(alpha, size=size)


@pytest.mark.parametrize("local_cells", [10**6, 0])
def test_wide_hdp_equals_dense(spark, monkeypatch, local_cells):
    monkeypatch.setattr(wide, "RANGE", 7)
    monkeypatch.setattr(wide, "CHUNK_CELLS", 40)
    rows = records()
    items, x, g, seeds = dense(spark, rows)
    p = wide.gather(spark.createDataFrame(rows, "id long, `group` string, items array<string>").repartition(3, "id"), "group", local_cells)
    assert (p.held is None) == (local_cells == 0) and p.n_items == len(items) and p.groups == ["x", "y", "z"]
    assert sum(r.n for r in p.table.select((F.length("seeds") / 8).alias("n")).collect()) == len({c.tobytes() for c in x.T}) < len(items)
    for steps in (1, 4, 200):
        m = wide.fit_hdp(p, k_max=4, n_init=1, max_iter=steps)
        q = of_matrix(x, g)
        one = q.item_means(), 4, 1.0, 1.0, np.ones(len(items)), np.ones(len(items)), steps, 1e-5, Fixed(seeds)
        run = hdp.run_cavi(q, *one)
        e = q.expect(*next(run))
        with pytest.raises(StopIteration) as end:
            while True:
                e = q.expect(*run.send(e))
        want = end.value.value
        assert np.allclose(m.beta_mean, want.beta_mean) and np.allclose(m.pi_mean, want.pi_mean)
        got = {(r.cluster, r.item): r.theta for r in wide.profiles(p, m).collect()}
        assert len(got) == 4 * len(items)
        assert np.allclose([[got[k + 1, w] for w in items] for k in range(4)], want.theta, atol=1e-4)
    assert want.converged and m.converged and m.elbo == pytest.approx(want.elbo)


def test_gammas():
    from kinfold.functions import special

    x = np.array([1e-6, 0.3, 1, 2.5, 7.9, 40, 3e5])
    high, psi = wide.gammas(x)
    assert np.allclose(high, special.lgamma(x), rtol=1e-12, atol=1e-12) and np.allclose(psi, special.digamma(x), rtol=1e-11)


def test_doc_words(spark, tmp_path):
    texts = [(1, "A b, año AÑO\nÉté—don't ŸY 東京x ǅz", "fr"), (2, "one", "en"), (2, "two one", "en"), (2, "three", "de"), (3, None, "en"), (4, "", None), (5, "only here", None)]
    d = written(spark, tmp_path, texts)
    want: dict = {}
    for i, text, lang in texts:
        want.setdefault((i, lang), set()).update(w for w in re.split(io.TOKEN, (text or "").lower()) if w)
    assert {(r.id, r.group): r["items"] for r in io.doc_words(spark, d, ("group",)).collect()} == {k: sorted(v) for k, v in want.items()}
    assert {r.id: r["items"] for r in io.doc_words(spark, d).collect()}[2] == ["one", "three", "two"]


def test_hdp_categories_reads_rare_words(spark, few_spanish):
    """Under the cut to words of 12 to 40 % of documents, Spanish had no records, which raised."""
    kinds = {r.category for r in catalog.hdp_categories(spark, few_spanish[0]).collect() if r.beta_weight > 0.01}
    assert "group_es_only" in kinds


def test_hdp_clusters_has_every_word(spark, few_spanish):
    """Under the cut, neither rare nor short words had rows."""
    d, words = few_spanish
    rows = catalog.hdp_clusters(spark, d).collect()
    want = {*words["en"], *words["es"], "unseen"}
    assert sorted(r.item for r in rows) == sorted([*want] * 10) and {r.cluster for r in rows} == set(range(1, 11))
    assert all(0 < r.theta < 1 for r in rows if r.cluster == 1)


@pytest.mark.parametrize("local_cells", [10**6, 0])
def test_wide_mixture_equals_dense(spark, local_cells):
    rows = records()
    items, x, _, seeds = dense(spark, rows)
    p = wide.gather(spark.createDataFrame(rows, "id long, `group` string, items array<string>"), None, local_cells)
    found = wide.select_k(p, [1, 3], n_init=2, max_iter=6)
    want = {}
    for k in (1, 3):
        for run in range(2):
            theta = np.clip(x.mean(0) * (0.5 + np.array([wide.uniform(seeds, 0, run, i) for i in range(k)])), 0.01, 0.99)
            pi = np.full(k, 1 / k)
            for step in range(7):
                z = np.log(pi) + x @ np.log(theta / (1 - theta)).T + np.log1p(-theta).sum(1)
                top = z.max(1, keepdims=True)
                r, total = np.exp(z - top), (top[:, 0] + np.log(np.exp(z - top).sum(1))).sum()
                r /= r.sum(1, keepdims=True)
                pi, theta = r.mean(0), np.clip(r.T @ x / r.sum(0)[:, None], 1e-10, 1 - 1e-10)
            want[k] = min(want.get(k, np.inf), mixture.bic(total, k, len(items), len(x)))
    assert dict(zip(found["k"], found["bic"])) == pytest.approx(want, rel=1e-9)
    with pytest.raises(ValueError):
        wide.select_k(p, [])


def test_select_k_bic_counts_every_word(spark, few_spanish):
    """Its table is the one of all 13 words; the cut left no Spanish and no single one."""
    d, words = few_spanish
    found = {r.k: r.bic for r in catalog.select_k_bic(spark, d).collect()}
    p = wide.gather(io.doc_words(spark, d))
    assert p.n_items == len(words["en"]) + len(words["es"]) + 1 and p.n_records == 177
    want = wide.select_k(p, range(2, 6), n_init=2, max_iter=50)
    assert found == pytest.approx(dict(zip(want["k"], want["bic"])), abs=1e-6)
