import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import special, stats
from kinfold.operators import graph, mining, network, prep, strata, validate, viewdata
from kinfold.plans import pipelines
from tests.fixtures import EXCLUSIVE, SCHEMA, TRIANGLES, fifty, planted


@pytest.fixture(scope="module")
def ev(spark):
    return spark.createDataFrame(fifty(), SCHEMA).persist()


def table(spark, *cells):
    return spark.createDataFrame([cells], "n11 long, n10 long, n01 long, n00 long")


def four():
    return [F.col(c) for c in ("n11", "n10", "n01", "n00")]


def test_contingency(ev):
    row = stats.contingency(prep.transactions(ev, min_items=1), "Item01", "Item02").first()
    assert tuple(row) == (10, 11, 4, 25)


@pytest.mark.parametrize("cells, value", [((10, 2, 3, 20), 200 / 6), ((5, 0, 0, 5), 121.0)])
def test_odds_ratio(spark, cells, value):
    assert table(spark, *cells).select(stats.odds_ratio(*four())).first()[0] == pytest.approx(value)


def test_odds_ratio_without_correction(spark):
    raw = lambda *c: table(spark, *c).select(stats.odds_ratio(*four(), "none")).first()[0]
    assert raw(5, 0, 0, 5) == math.inf and math.isnan(raw(0, 0, 3, 5))
    with pytest.raises(ValueError):
        stats.odds_ratio(*four(), "other")


@pytest.mark.parametrize("cells, value", [((10, 0, 0, 10), 1), ((5, 5, 5, 5), 0), ((0, 10, 10, 0), -1), ((5, 0, 0, 0), 0)])
def test_phi(spark, cells, value):
    assert table(spark, *cells).select(stats.phi(*four())).first()[0] == pytest.approx(value)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.data())
def test_fisher(n, data):
    ka, kb = data.draw(st.integers(0, n)), data.draw(st.integers(0, n))
    n11 = data.draw(st.integers(max(0, ka + kb - n), min(ka, kb)))
    exact = sum(Fraction(math.comb(ka, j) * math.comb(n - ka, kb - j), math.comb(n, kb)) for j in range(n11, min(ka, kb) + 1))
    assert special.fisher_right([n11], [ka], [kb], [n])[0] == pytest.approx(float(exact), abs=1e-10)


def test_special():
    assert special.digamma(1.0) == pytest.approx(-0.5772156649015329)
    assert special.beta_quantile(0.5, 2, 2) == pytest.approx(0.5)
    assert special.beta_cdf(0.3, 1, 1) == pytest.approx(0.3)
    assert special.chi_square_p(3.841458820694124) == pytest.approx(0.05)


def adjusted(p, method):
    """The corrections step by step."""
    m, order = len(p), sorted(range(len(p)), key=lambda i: p[i])
    out = [0.0] * m
    if method == "bonferroni":
        return [min(1, x * m) for x in p]
    if method == "holm":
        top = 0.0
        for k, i in enumerate(order):
            top = max(top, (m - k) * p[i])
            out[i] = min(1, top)
        return out
    low = 1.0
    for k, i in reversed(list(enumerate(order, 1))):
        low = min(low, p[i] * m / k)
        out[i] = low
    return out


@pytest.mark.parametrize("method", ["bh", "bonferroni", "holm"])
def test_corrections(spark, method):
    p = [round(x, 2) for x in np.random.default_rng(1).random(80) ** 2]
    df = spark.createDataFrame(list(enumerate(map(float, p))), "i long, p_value double")
    got = [r.p_adjusted for r in stats.adjust(df, method).orderBy("i").collect()]
    assert got == pytest.approx(adjusted(p, method))
    with pytest.raises(ValueError):
        stats.adjust(df, "other")


def test_stars(spark):
    df = spark.createDataFrame([(0.0,), (0.001,), (0.01,), (0.05,)], "p double")
    assert [r[0] for r in df.select(stats.stars(F.col("p"))).collect()] == ["***", "**", "*", "ns"]


def test_validate_rules(spark, ev):
    rules = mining.association_rules(prep.transactions(ev), min_count=5)
    found = {(tuple(r.lhs), r.rhs): r for r in validate.validate_rules(rules, ev).collect()}
    r = found[(("Item02",), "Item01")]
    assert r.observed == 10 and r.expected == round(21 * 14 / 50, 1) and r.item_pair == "Item01 + Item02"
    assert r.p_value == pytest.approx(special.fisher_right([10], [21], [14], [50])[0])
    sets = validate.validate_rules(mining.frequent_itemsets(prep.transactions(ev), min_count=5), ev, "chisq", "holm")
    assert sets.count() == 2
    assert "Item01" in validate.results_summary(rules)


def test_networks(spark, ev):
    pairs = {(r.item_a, r.item_b): r for r in network.pairwise_associations(ev).collect()}
    assert pairs[("Item03", "Item04")].observed == 2
    assert ("Item03", "Item04") not in {(r.item_a, r.item_b) for r in network.pairwise_associations(ev, timing="concurrent").collect()}
    for timing, n in (("all", 50), ("concurrent", 18), ("sequential", 2)):
        assert network.build_network(ev, timing=timing).n_records.first()[0] == n


def test_louvain_and_gain():
    g = graph.graph_of(TRIANGLES)
    found = graph.detect_communities(g)
    assert sorted(map(tuple, found.members().values())) == [("a", "b", "c"), ("d", "e", "f")]
    parts = [0, 0, 1, 1, 1, 2]
    for node in range(6):
        alone = [*parts]
        alone[node] = 99
        for c in (0, 1, 2):
            moved = [*alone]
            moved[node] = c
            delta = graph.modularity(g, moved) - graph.modularity(g, alone)
            assert graph.modularity_gain(g, node, c, alone) == pytest.approx(delta)
    with pytest.raises(ValueError):
        graph.detect_communities(g, "other")
    assert len(graph.detect_communities(g, "label_propagation").table) == 6
    assert "2" in graph.network_summary(g, found)


def test_centrality(spark):
    g = graph.graph_of(TRIANGLES)
    b = dict(zip(g.items, graph.betweenness(g)))
    assert b["c"] == b["d"] == pytest.approx(0.6) and b["a"] == 0
    edges = spark.createDataFrame(TRIANGLES, "item_a string, item_b string, weight double")
    spark_side = {r["item"]: r.clustering for r in network.clustering_coefficient(edges).collect()}
    assert spark_side == pytest.approx(dict(zip(g.items, graph.clustering(g))))
    parts = spark.createDataFrame([(i, 1 if i in "abc" else 2) for i in "abcdef"], "item string, community long")
    assert network.modularity(edges, parts).first()[0] == pytest.approx(graph.modularity(g, [1, 1, 1, 2, 2, 2]))


def test_rand_index(spark):
    assert graph.adjusted_rand([1, 1, 2, 2], [1, 1, 2, 2]) == graph.adjusted_rand([1, 1, 2, 2], [2, 2, 1, 1]) == 1
    a, b = [1, 1, 2, 2, 3, 3, 1], [1, 2, 2, 2, 3, 1, 1]
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    assert network.adjusted_rand(df, "a", "b").first().ari == pytest.approx(graph.adjusted_rand(a, b))
    with pytest.raises(ValueError):
        graph.adjusted_rand([1], [1, 2])


def test_compare_networks(spark):
    net = lambda rows: network.Network(spark.createDataFrame(rows, "item_a string, item_b string, weight double"), None, None)
    part = lambda items: spark.createDataFrame([(i, 1) for i in items], "item string, community long")
    found = network.compare_networks(net([("a", "b", 1.0), ("b", "c", 2.0)]), net([("a", "b", 3.0)]), part("abc"), part("ab"))
    assert [tuple(r) for r in found.shared.collect()] == [("a", "b", 1.0, 3.0)]
    assert found.only_a.count() == 1 and found.only_b.count() == 0 and found.ari == 1.0
    apart = network.compare_networks(net([("A1", "A2", 1.0)]), net([("B1", "B2", 1.0)]), part(["A1", "A2"]), part(["B1", "B2"]))
    assert apart.ari is None


def test_compare_strata(spark):
    kind = "lhs array<string>, rhs string, support double, lift double, n long"
    a = spark.createDataFrame([(["x"], "y", 0.1, 2.0, 5), (["y", "x"], "z", 0.1, 2.0, 5), (["GA1"], "y", 0.1, 2.0, 5)], kind)
    b = spark.createDataFrame([(["x"], "y", 0.2, 1.0, 4), (["x"], "y", 0.2, 3.0, 4), (["q"], "y", 0.1, 1.0, 2)], kind)
    rows = {r.rule_key: r for r in strata.compare_strata(a, b, ("A", "B"), EXCLUSIVE).collect()}
    assert rows["x => y"].category == "universal" and rows["x => y"].group_b_lift == 3.0
    assert rows["x + y => z"].category == "group_a_only" and rows["x + y => z"].group_b_lift is None
    assert rows["GA1 => y"].category == "group_specific_item" and rows["q => y"].category == "group_b_only"
    assert list(rows) == sorted(rows)


def test_pipelines(spark, ev, tmp_path):
    ev.write.parquet(str(tmp_path / "events"))
    full = pipelines.full_pipeline(str(tmp_path / "events"), min_count=3, exclusive=EXCLUSIVE)
    assert set(full.stratified) == {"A", "B"} and full.rules.count() > 0
    assert full.stratified["A"].filter("rhs = 'GB1'").count() == 0
    three = spark.createDataFrame(planted(True), SCHEMA)
    net = pipelines.network_pipeline(three, min_count=5)
    assert net.communities.n_communities >= 3 and set(net.stratified) == {"A", "B", "C"}
    assert len(net.comparison) == 3
    assert net.comparison[("A", "B")].shared.count() == 1


def test_layouts_and_colours():
    g = graph.graph_of([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 2.0), ("x", "y", 1.0)])
    for kind in ("stress", "spring", "shell", "circle"):
        t = viewdata.layout(g, kind)
        assert list(t["item"]) == g.items and t[["x", "y"]].notna().all().all()
    assert viewdata.layout(g, "unknown").equals(viewdata.layout(g, "stress"))
    t = viewdata.layout(g, "stress").set_index("item")
    far = lambda a, b: ((t.loc[a, "x"] - t.loc[b, "x"]) ** 2 + (t.loc[a, "y"] - t.loc[b, "y"]) ** 2) ** 0.5
    assert far("a", "b") < far("a", "c") < far("a", "d")
    colours = viewdata.categorical_colors(30)
    assert len(set(colours)) == 30 and all(len(c) == 7 and c[0] == "#" for c in colours)
