"""Registered queries over the reference's operators, with their DuckDB equivalents.

Inputs are the event views of ``sources.io``: baskets (orders and parts' brands or types)
and document tokens. Doubles are rounded to six places on both sides. Odds ratios, which the pair tables
round to four places, and the strata's expectations, to two, are left out of them: ties
in the next place depend on how an engine rounds. ``odds_ratio_pairs`` has the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import stats
from kinfold.functions.schema import STRATUM
from kinfold.operators import graph, hdp, mining, mixture, network, posterior, prep, strata, validate, viewdata, wide
from kinfold.operators.patterns import compress
from kinfold.plans import pipelines
from kinfold.sources import io

DIGITS = 6
BRANDS = [f"Brand#{m}{n}" for m in range(1, 6) for n in range(1, 6)]
SIDES = ("BUILDING", "MACHINERY")
NET = {"min_count": 8, "alpha": 0.2}
WORDS = {"least": 0.12, "most": 0.4}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, counts to long, arrays to strings."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "double":
            out[name] = F.round(f"`{name}`", DIGITS) + F.lit(0.0)  # no negative zero
        elif kind == "int":
            out[name] = F.col(f"`{name}`").cast("long")
        elif kind.startswith("array<string"):
            out[name] = F.array_join(f"`{name}`", "|")
    return df.withColumns(out) if out else df


def _brands(s, d):
    return io.baskets(s, d)


def _types(s, d):
    return io.baskets(s, d, "p_type")


def _tokens(s, d):
    return io.doc_tokens(s, d)


def _words(s, d):
    return io.doc_tokens(s, d, **WORDS)


def _exclusive(ev: DataFrame) -> DataFrame:
    """Items that one group alone has."""
    per = ev.groupBy("item").agg(F.count_distinct("group").alias("k"), F.min("group").alias("xgroup"))
    return per.filter("k = 1").select("xgroup", "item")


def record_summary(s, d):
    return rounded(prep.record_summary(_brands(s, d)))


def group_filter_items(s, d):
    return prep.filter_group(_tokens(s, d), "en").groupBy("item").agg(F.count("*").alias("n"))


def exclusive_items_filter(s, d):
    ev = _tokens(s, d)
    return prep.filter_group(ev, "fr", _exclusive(ev)).groupBy("item").agg(F.count("*").alias("n"))


def _timing(s, d, timing, window):
    return prep.filter_by_timing(_brands(s, d), timing, window).groupBy("id").agg(F.count("*").alias("n"))


def timing_concurrent(s, d):
    return _timing(s, d, "concurrent", 0)


def timing_sequential(s, d):
    return _timing(s, d, "sequential", 0)


def timing_window2(s, d):
    return _timing(s, d, "sequential", 2)


def transactions_long(s, d):
    return prep.long_form(prep.transactions(_brands(s, d), timing="concurrent", window=1))


def transactions_onehot(s, d):
    wide = prep.one_hot(prep.transactions(_brands(s, d)), BRANDS)
    return wide.select("id", *(F.col(f"`{b}`").cast("long").alias(b) for b in BRANDS))


def frequent_itemsets(s, d):
    return rounded(mining.frequent_itemsets(prep.transactions(_types(s, d)), 0.01))


def association_rules(s, d):
    return rounded(mining.association_rules(prep.transactions(_types(s, d)), 0.01, 0.1))


def fp_growth_itemsets(s, d):
    return rounded(mining.fp_growth_itemsets(prep.transactions(_types(s, d)), 100))


def _pairs(s, d):
    return network.pair_counts(_brands(s, d))




def _cols():
    return [F.col(c) for c in ("n11", "n_a", "n_b", "n")]


def contingency_pairs(s, d):
    names = ("n11", "n10", "n01", "n00")
    return _pairs(s, d).select("item_a", "item_b", *(c.alias(x) for c, x in zip(stats.cells(*_cols()), names)))


def odds_ratio_pairs(s, d):
    four = stats.cells(*_cols())
    return rounded(_pairs(s, d).select("item_a", "item_b", stats.odds_ratio(*four).alias("odds_ratio"), stats.odds_ratio(*four, "none").alias("raw")))


def phi_pairs(s, d):
    return rounded(_pairs(s, d).select("item_a", "item_b", stats.phi(*stats.cells(*_cols())).alias("phi")))


def chisq_statistic(s, d):
    return rounded(_pairs(s, d).select("item_a", "item_b", stats.chi_square(*stats.cells(*_cols())).alias("chi_square")))


def chisq_p_values(s, d):
    return rounded(_pairs(s, d).select("item_a", "item_b", stats.p_value(*_cols(), "chisq").alias("p_value")))


def _tested(s, d):
    return _pairs(s, d).select("item_a", "item_b", stats.p_value(*_cols()).alias("p_value"))


def fisher_right_tail(s, d):
    return rounded(_tested(s, d))


def adjust_bh(s, d):
    return rounded(stats.adjust(_tested(s, d), "bh"))


def adjust_bonferroni(s, d):
    return rounded(stats.adjust(_tested(s, d), "bonferroni"))


def adjust_holm(s, d):
    return rounded(stats.adjust(_tested(s, d), "holm"))


def significance_labels(s, d):
    return _tested(s, d).select("item_a", "item_b", stats.stars(F.col("p_value")).alias("stars"))


def _validated(df):
    return rounded(df.drop("expected", "odds_ratio"))


def validated_rules(s, d):
    ev = _types(s, d)
    rules = mining.association_rules(prep.transactions(ev), 0.01, 0.1)
    return _validated(validate.validate_rules(rules, ev))


def validated_itemsets(s, d):
    ev = _types(s, d)
    return _validated(validate.validate_rules(mining.frequent_itemsets(prep.transactions(ev), 0.01), ev))


def top_rules(s, d):
    rules = mining.association_rules(prep.transactions(_types(s, d)), 0.01, 0.1)
    return rounded(validate.top_rules(rules, 20).select("rule", "lift", "n"))


def pairwise_associations(s, d):
    return rounded(network.pairwise_associations(_brands(s, d)).drop("odds_ratio"))


def pairwise_by_group(s, d):
    return rounded(network.pairwise_associations(prep.strata(_brands(s, d)), keys=(STRATUM,)).drop("odds_ratio", "expected"))


def session_pairs(s, d):
    return network.pair_counts(io.sessions(s, d))


def _net(s, d):
    return network.build_network(_words(s, d), **NET)


def network_edges(s, d):
    return rounded(_net(s, d).edges.drop("odds_ratio"))


def network_nodes(s, d):
    return rounded(_net(s, d).nodes)


def node_degree_strength(s, d):
    return rounded(network.degree_strength(_net(s, d).edges))


def node_clustering(s, d):
    return rounded(network.clustering_coefficient(_net(s, d).edges))


def _dominant(ev: DataFrame) -> DataFrame:
    """item, community: the group with most rows of the item, the first on ties."""
    per = ev.groupBy("item", "group").agg(F.count("*").alias("k"))
    return per.groupBy("item").agg(F.min_by("group", F.struct((-F.col("k")).alias("k"), "group")).alias("community"))


def partition_modularity(s, d):
    return rounded(network.modularity(_net(s, d).edges, _dominant(_words(s, d))))


def partition_ari(s, d):
    both = _dominant(_tokens(s, d)).withColumn("letter", F.substring("item", 1, 1))
    return rounded(network.adjusted_rand(both, "community", "letter"))


def _side_edges(s, d, side):
    return network.build_network(_brands(s, d), group=side, min_count=5, alpha=2.0).edges


def network_shared_edges(s, d):
    return rounded(network.shared_edges(*(_side_edges(s, d, x) for x in SIDES)))


def network_only_edges(s, d):
    return rounded(network.only_edges(*(_side_edges(s, d, x) for x in SIDES)))


def _side_rules(s, d, side):
    trans = prep.transactions(_types(s, d), side)
    return mining.association_rules(trans, min_count=30, min_confidence=0.3, max_length=3)


def compare_strata(s, d):
    first = _types(s, d).agg(F.min("item").alias("item")).select(F.lit(SIDES[0]).alias("xgroup"), "item")
    found = strata.compare_strata(*(_side_rules(s, d, x) for x in SIDES), SIDES, first)
    low = [x.lower() for x in SIDES]
    return rounded(found.select("rule_key", *(f"group_{x}_{m}" for x in low for m in ("support", "lift", "n")), "category"))


def stratified_rules(s, d):
    rules, _ = strata.stratified_rules(_types(s, d), min_count=30, min_confidence=0.3, max_length=3)
    return rounded(rules.select("stratum", "lhs", "rhs", "support", "confidence", "lift", "n", "p_value"))


def eb_priors(s, d):
    trans = prep.transactions(_brands(s, d))
    n = trans.agg(F.count("*").alias("total"))
    mean = F.col("n") / F.col("total")
    return rounded(prep.item_counts(trans).join(F.broadcast(n)).select("item", (10 * mean + 1).alias("a"), (10 * (1 - mean) + 1).alias("b")))


def em_single_step(s, d):
    """One EM step of two classes from theta 0.3 and 0.6 on alternate items, flat priors."""
    import numpy as np

    p = compress(prep.transactions(_brands(s, d)))
    theta = np.array([[0.3 + 0.3 * ((i + k) % 2) for i in range(len(p.items))] for k in range(2)])
    e = p.expect(*mixture.natural(theta, np.array([0.5, 0.5])))
    ones = np.ones(len(p.items))
    theta, pi = mixture.m_step(e.by_group.sum(0), e.by_item, ones, ones, 1.0)
    rows = [(k + 1, i, float(pi[k]), float(theta[k, j])) for k in range(2) for j, i in enumerate(p.items)]
    return rounded(s.createDataFrame(rows, "cluster long, item string, pi double, theta double"))


_PI = [(1, 0.4, "a", 0.5), (1, 0.4, "b", 0.4), (2, 0.3, "a", 0.6), (2, 0.3, "b", 0.2), (3, 0.2, "a", 0.3), (3, 0.2, "b", 0.01), (4, 0.005, "a", 0.5), (4, 0.005, "b", 0.5), (5, 0.1, "a", 0.01), (5, 0.1, "b", 0.02)]


def hdp_category_rules(s, d):
    return hdp.categories(s.createDataFrame(_PI, "cluster long, beta_weight double, `group` string, pi double"))


def upset_intersections(s, d):
    return rounded(viewdata.upset(prep.transactions(_types(s, d)), 5, 100)[0].select("combination", "n"))


def item_prevalence(s, d):
    return rounded(viewdata.item_prevalence(_brands(s, d), 30, ["AUTOMOBILE", "BUILDING"]))


def phi_matrix(s, d):
    return rounded(viewdata.phi_pairs(prep.transactions(_brands(s, d))))


def rule_matrix(s, d):
    return rounded(viewdata.arm_matrix(mining.association_rules(prep.transactions(_types(s, d)), 0.01, 0.1)))


def _frame(s: SparkSession, pdf, schema: str) -> DataFrame:
    return rounded(s.createDataFrame(pdf.values.tolist(), schema))


def louvain_communities(s, d):
    found = graph.detect_communities(graph.collect_graph(_net(s, d).edges))
    return _frame(s, found.table, "item string, community long")


def label_propagation(s, d):
    found = graph.detect_communities(graph.collect_graph(_net(s, d).edges), "label_propagation")
    return _frame(s, found.table, "item string, community long")


def betweenness(s, d):
    g = graph.collect_graph(_net(s, d).edges)
    return rounded(s.createDataFrame(list(zip(g.items, graph.betweenness(g).tolist())), "item string, betweenness double"))


def network_metrics(s, d):
    found = pipelines.described(_net(s, d), "louvain")
    return _frame(s, found.metrics, "item string, degree long, strength double, betweenness double, clustering double, prevalence double")


def _word_records(s, d):
    return prep.transactions(_words(s, d))


def em_profiles(s, d):
    found = mixture.cluster(_word_records(s, d), [4], n_init=2, max_iter=50)
    return _frame(s, found.profiles, "cluster long, proportion double, item string, theta double")


def em_assignments(s, d):
    return mixture.cluster(_word_records(s, d), [4], n_init=2, max_iter=50).assignments.groupBy("cluster").agg(F.count("*").alias("n"))


def select_k_bic(s, d):
    """Of all words of all documents with two words or more."""
    records = io.doc_words(s, d).filter(F.size("items") >= 2)
    p = wide.gather(records)
    found = wide.select_k(p, range(2, 6), n_init=2, max_iter=50)
    p.table.unpersist()
    return _frame(s, found.astype({"k": object}), "k long, bic double")


def _hdp(s, d):
    """Of all words of all documents with a language, as records in it; as everywhere, records have two items or more."""
    records = io.doc_words(s, d, ("group",)).filter(F.col("group").isNotNull() & (F.size("items") >= 2))
    found = wide.gather(records, "group")
    return found, wide.fit_hdp(found, k_max=10, n_init=1, max_iter=100)


def hdp_clusters(s, d):
    return rounded(wide.profiles(*_hdp(s, d)))


def hdp_categories(s, d):
    p, m = _hdp(s, d)
    p.table.unpersist()
    return rounded(hdp.categories(wide.weights(p, m)))


_INTERVALS = "`group` string, k long, cluster long, item string, pi_mean double, pi_ci_low double, pi_ci_high double, theta_mean double, theta_ci_low double, theta_ci_high double"


def posterior_intervals_gibbs(s, d):
    return _frame(s, posterior.clustering_gibbs(_types(s, d), 2, n_samples=60).table(), _INTERVALS)


def posterior_intervals_vi(s, d):
    return _frame(s, posterior.clustering_vi(_types(s, d), 2, n_samples=200).table(), _INTERVALS)


QUERIES = (
    record_summary, group_filter_items, exclusive_items_filter, timing_concurrent, timing_sequential, timing_window2,
    transactions_long, transactions_onehot, frequent_itemsets, association_rules, fp_growth_itemsets, contingency_pairs,
    odds_ratio_pairs, phi_pairs, chisq_statistic, chisq_p_values, fisher_right_tail, adjust_bh, adjust_bonferroni, adjust_holm,
    significance_labels, validated_rules, validated_itemsets, top_rules, pairwise_associations, pairwise_by_group, session_pairs,
    network_edges, network_nodes, node_degree_strength, node_clustering, partition_modularity, partition_ari,
    network_shared_edges, network_only_edges, compare_strata, stratified_rules, eb_priors, em_single_step, hdp_category_rules,
    upset_intersections, item_prevalence, phi_matrix, rule_matrix, louvain_communities, label_propagation, betweenness,
    network_metrics, em_profiles, em_assignments, select_k_bic, hdp_clusters, hdp_categories, posterior_intervals_gibbs,
    posterior_intervals_vi,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


# The same in DuckDB SQL.


def _baskets(item: str = "p_brand") -> str:
    return f"""e as (select l_orderkey as id, {item} as item, c_mktsegment as g, year(l_shipdate) as year
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"""


def _docs(least: float = 0.04, most: float = 0.4) -> str:
    return f"""e0 as (select doc_id as id, lang as g, unnest(list_distinct(regexp_split_to_array(lower(text), '{io.TOKEN}'))) as item from documents),
e1 as (select * from e0 where length(item) >= 4),
e as (select * from e1 where item in (select item from e1 group by item
  having count(*) >= {least} * (select count(*) from documents) and count(*) <= {most} * (select count(*) from documents)))"""


def _trans(where: str = "") -> str:
    return f"""ev as (select distinct id, item from e {where}), size as (select id, count(*) as k from ev group by id),
t as (select id, item from ev join size using (id) where k >= 2)"""


def _pair_sql(source: str = "ev", key: str = "") -> str:
    """Pair counts from distinct (key, id, item) rows."""
    k = f"{key}, " if key else ""
    on = f"a.{key} = b.{key} and " if key else ""
    ka = f"a.{key}, " if key else ""
    use = f"on tot.{key} = pc.{key}" if key else "on true"
    return f"""cnt as (select {k}item, count(*) as k from {source} group by all), tot as (select {k}count(distinct id) as n from {source} {"group by all" if key else ""}),
pc as (select {ka}a.item as item_a, b.item as item_b, count(*) as n11 from {source} a join {source} b on {on}a.id = b.id and a.item < b.item group by all),
pairs as (select pc.*, ca.k as n_a, cb.k as n_b, tot.n from pc join cnt ca on {f"ca.{key} = pc.{key} and " if key else ""}ca.item = pc.item_a
  join cnt cb on {f"cb.{key} = pc.{key} and " if key else ""}cb.item = pc.item_b join tot {use})"""


FISHER = """least(1, list_sum(list_transform(range(n11, least(n_a, n_b) + 1), lambda j:
  exp(lgamma(n_a + 1) - lgamma(j + 1) - lgamma(n_a - j + 1) + lgamma(n - n_a + 1) - lgamma(n_b - j + 1) - lgamma(n - n_a - n_b + j + 1)
    - lgamma(n + 1) + lgamma(n_b + 1) + lgamma(n - n_b + 1)))))"""
PHI = """case when n_a = 0 or n_b = 0 or n_a = n or n_b = n then 0 else
  (n11 * (n - n_a - n_b + n11)::double - (n_a - n11) * (n_b - n11)::double) / (sqrt(n_a * (n - n_a)::double) * sqrt(n_b * (n - n_b)::double)) end"""
HALF = "(case when n11 = 0 or n_a = n11 or n_b = n11 or n - n_a - n_b + n11 = 0 then 0.5 else 0 end)"
ODDS = f"""(n11 + {HALF}::double) * (n - n_a - n_b + n11 + {HALF}::double) / ((n_a - n11 + {HALF}::double) * (n_b - n11 + {HALF}::double))"""


def _bh(key: str = "") -> str:
    part = f"partition by {key}" if key else ""
    return f"""ranked as (select *, count(*) over ({part}) as m, count(*) over ({part} order by p_value range unbounded preceding) as rk from tested),
adjusted as (select * exclude (m, rk), least(1, min(p_value * m / rk) over ({part} order by p_value desc range unbounded preceding)) as p_adjusted from ranked)"""


def _associations(key: str = "") -> str:
    k = f"{key}, " if key else ""
    return f"""tested as (select {k}item_a, item_b, n11 as observed, round_even(n_a::double * n_b / n, 2) as expected,
  round_even(n11 / (n_a::double * n_b / n), 4) as lift, round_even({PHI}, 4) + 0 as phi, round_even({ODDS}, 4) as odds_ratio,
  {FISHER} as p_value, n_a, n_b from pairs), {_bh(key)}"""


_NET = f"""{_docs(**WORDS)}, ev as (select distinct id, item from e), {_pair_sql()}, {_associations()},
edges as (select *, lift as weight from adjusted where observed >= {NET["min_count"]} and p_adjusted < {NET["alpha"]} and lift > 1),
ends as (select item_a as item, item_b as other, weight from edges union all select item_b, item_a, weight from edges)"""

_DOMINANT = "dom as (select item, min_by(g, row(-k, g)) as community from (select item, g, count(*) as k from e group by all) group by item)"


def _itemsets(least: str = "ceil(0.01 * n_txns - 1e-9)", most: int = 4) -> str:
    """sets(items, n, length) and n_txns, over t; a level's occurrences are those of the level before that are frequent."""
    parts = ["nt as (select count(distinct id) as n_txns from t), o1 as materialized (select id, [item] as items from t)"]
    for k in range(1, most + 1):
        if k > 1:
            parts.append(f"o{k} as materialized (select o.id, list_append(o.items, t.item) as items from o{k - 1} o join f{k - 1} using (items) join t on t.id = o.id and t.item > o.items[{k - 1}])")
        parts.append(f"f{k} as materialized (select items, count(*) as n, n_txns from o{k}, nt group by items, n_txns having count(*) >= {least})")
    every = " union all ".join(f"select items, n, {k} as length, n_txns from f{k}" for k in range(1, most + 1))
    return ", ".join(parts) + f", sets as ({every})"


def _rules(confidence: float) -> str:
    return f"""r0 as (select items, n, length, n_txns, unnest(items) as rhs from sets where length >= 2),
r1 as (select *, list_filter(items, lambda x: x <> rhs) as lhs from r0),
rules as (select r1.lhs, r1.rhs, r1.n::double / r1.n_txns as support, r1.n::double / l.n as confidence, l.n::double / r1.n_txns as coverage,
    (r1.n::double / l.n) / (s.n::double / r1.n_txns) as lift, r1.n, r1.length
  from r1 join sets l on l.items = r1.lhs join sets s on s.length = 1 and s.items[1] = r1.rhs where r1.n::double / l.n >= {confidence})"""


_RULES = f"{_baskets('p_type')}, {_trans()}, {_itemsets()}, {_rules(0.1)}"


def _validated_sql(table: str, pairs: str, names: str) -> str:
    return f"""with {_RULES}, {_pair_sql()}, pr as ({pairs}), fam as (select distinct item_a, item_b from pr),
tested as (select item_a, item_b, n11, {FISHER} as p_value from fam join pairs using (item_a, item_b)), {_bh()},
joined as (select pr.*, n11, p_value, p_adjusted from pr join adjusted using (item_a, item_b)),
worst as (select {names}, max_by(row(n11, p_value, p_adjusted), row(p_adjusted, -place)) as w, string_agg(item_a || ' + ' || item_b, '; ' order by place) as item_pair from joined group by {names})"""


_RULE_PAIRS = """select lhs, rhs, i as place, least(lhs[i], rhs) as item_a, greatest(lhs[i], rhs) as item_b from (select lhs, rhs, unnest(range(1, len(lhs) + 1)) as i from rules)"""
_SET_PAIRS = """select items, i * 100 + j as place, items[i] as item_a, items[j] as item_b from (select items, i, unnest(range(i + 1, len(items) + 1)) as j
  from (select items, unnest(range(1, len(items))) as i from sets where length >= 2))"""


def _side_sql(name: str, side: str) -> str:
    inner = f"{_baskets()}, ev as (select distinct id, item from e where g = '{side}'), {_pair_sql()}, {_associations()}"
    return f"{name} as (with {inner} select item_a, item_b, lift as weight from adjusted where observed >= 5 and p_adjusted < 2 and lift > 1)"


def _side_rules_sql(name: str, side: str) -> str:
    trans = _trans(f"where g = '{side}'")
    return f"""{name} as (with {_baskets("p_type")}, {trans}, {_itemsets("30", 3)}, {_rules(0.3)}
  select array_to_string(lhs, ' + ') || ' => ' || rhs as rule_key, lhs, rhs, support, lift, n from rules)"""


def _timing_sql(test: str) -> str:
    return f"""with {_baskets()} select id, count(*) as n from e where id in
  (select id from e group by id having count(distinct item) >= 2 and max(year) - min(year) {test}) group by id"""


_THETA = "0.3 + 0.3 * ((i + k) % 2)"
_STRATA_RULES = " union all ".join(
    f"""select '{g}' as stratum, * from (with {_baskets("p_type")}, {_trans(f"where g = '{g}'")}, {_itemsets("30", 3)}, {_rules(0.3)}, {_pair_sql()},
pr as ({_RULE_PAIRS}), fam as (select distinct item_a, item_b from pr), tested as (select item_a, item_b, {FISHER} as p_value from fam join pairs using (item_a, item_b)), {_bh()},
worst as (select lhs, rhs, max_by(p_value, row(p_adjusted, -place)) as p_value from pr join adjusted using (item_a, item_b) group by lhs, rhs)
select array_to_string(lhs, '|') as lhs, rhs, round(support, 6) as support, round(confidence, 6) as confidence, round(lift, 6) as lift, n, round(p_value, 6) as p_value
from rules join worst using (lhs, rhs))"""
    for g in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
)


def oracle_sql() -> dict[str, str]:
    brands = f"with {_baskets()}, ev as (select distinct id, item from e), {_pair_sql()}"
    tested = f"{brands}, tested as (select item_a, item_b, {FISHER} as p_value from pairs)"
    return {
        "record_summary": f"""with {_baskets()} select id, min(g) as "group", count(*) as n_items, array_to_string(list_sort(list_distinct(list(item))), '|') as items from e group by id""",
        "group_filter_items": f"with {_docs()} select item, count(*) as n from e where g = 'en' group by item",
        "exclusive_items_filter": f"""with {_docs()}, x as (select item, min(g) as xg from e group by item having count(distinct g) = 1)
select item, count(*) as n from e where g = 'fr' and item not in (select item from x where xg <> 'fr') group by item""",
        "timing_concurrent": _timing_sql("<= 0"),
        "timing_sequential": _timing_sql("> 0"),
        "timing_window2": _timing_sql("> 2"),
        "transactions_long": f"with {_baskets()} select distinct id, item from e where id in (select id from e group by id having count(distinct item) >= 2 and max(year) - min(year) <= 1)",
        "transactions_onehot": f"with {_baskets()}, {_trans()} select id, " + ", ".join(f"""count(*) filter (item = '{b}') as "{b}" """ for b in BRANDS) + " from t group by id",
        "frequent_itemsets": f"with {_RULES} select array_to_string(items, '|') as items, round(n::double / n_txns, 6) as support, n, length::bigint as length from sets where length >= 2",
        "association_rules": f"""with {_RULES} select array_to_string(lhs, '|') as lhs, rhs, round(support, 6) as support, round(confidence, 6) as confidence,
  round(coverage, 6) as coverage, round(lift, 6) as lift, n, length::bigint as length from rules""",
        "fp_growth_itemsets": f"with {_baskets('p_type')}, {_trans()}, {_itemsets('100')} select array_to_string(items, '|') as items, n, length::bigint as length from sets where length >= 2",
        "contingency_pairs": f"{brands} select item_a, item_b, n11, n_a - n11 as n10, n_b - n11 as n01, n - n_a - n_b + n11 as n00 from pairs",
        "odds_ratio_pairs": f"""{brands} select item_a, item_b, round({ODDS}, 6) as odds_ratio, round(case when n_a = n11 or n_b = n11 then
  case when n11 * (n - n_a - n_b + n11) = 0 then 'nan'::double else 'inf'::double end else n11::double * (n - n_a - n_b + n11) / ((n_a - n11)::double * (n_b - n11)) end, 6) as raw from pairs""",
        "phi_pairs": f"{brands} select item_a, item_b, round({PHI}, 6) as phi from pairs",
        "chisq_statistic": f"""{brands} select item_a, item_b, round(n * power(n11::double * (n - n_a - n_b + n11) - (n_a - n11)::double * (n_b - n11), 2)
  / (n_a::double * (n - n_a) * n_b * (n - n_b)), 6) as chi_square from pairs""",
        "fisher_right_tail": f"{tested} select item_a, item_b, round(p_value, 6) as p_value from tested",
        "adjust_bh": f"{tested}, {_bh()} select item_a, item_b, round(p_value, 6) as p_value, round(p_adjusted, 6) as p_adjusted from adjusted",
        "adjust_bonferroni": f"{tested} select item_a, item_b, round(p_value, 6) as p_value, round(least(1, p_value * count(*) over ()), 6) as p_adjusted from tested",
        "adjust_holm": f"""{tested}, s as (select *, (count(*) over () - rank() over (order by p_value) + 1) * p_value as st from tested)
select item_a, item_b, round(p_value, 6) as p_value, round(least(1, max(st) over (order by p_value range unbounded preceding)), 6) as p_adjusted from s""",
        "significance_labels": f"""{tested} select item_a, item_b, case when p_value < 0.001 then '***' when p_value < 0.01 then '**' when p_value < 0.05 then '*' else 'ns' end as stars from tested""",
        "validated_rules": f"""{_validated_sql("rules", _RULE_PAIRS, "lhs, rhs")} select array_to_string(lhs, '|') as lhs, rhs, round(support, 6) as support, round(confidence, 6) as confidence,
  round(coverage, 6) as coverage, round(lift, 6) as lift, n, length::bigint as length, item_pair, w[1] as observed, round(w[2], 6) as p_value, round(w[3], 6) as p_adjusted, w[3] < 0.05 as significant
from rules join worst using (lhs, rhs)""",
        "validated_itemsets": f"""{_validated_sql("sets", _SET_PAIRS, "items")} select array_to_string(items, '|') as items, round(n::double / n_txns, 6) as support, n, length::bigint as length,
  item_pair, w[1] as observed, round(w[2], 6) as p_value, round(w[3], 6) as p_adjusted, w[3] < 0.05 as significant from sets join worst using (items)""",
        "top_rules": f"""with {_RULES} select array_to_string(lhs, ' + ') || ' => ' || rhs as rule, round(lift, 6) as lift, n from rules order by rules.lift desc, 1 limit 20""",
        "pairwise_associations": f"{brands}, {_associations()} select * exclude (odds_ratio) replace (round(p_value, 6) as p_value, round(p_adjusted, 6) as p_adjusted) from adjusted",
        "pairwise_by_group": f"""with {_baskets()}, ev as (select distinct g as stratum, id, item from e), {_pair_sql("ev", "stratum")}, {_associations("stratum")}
select * exclude (odds_ratio, expected) replace (round(p_value, 6) as p_value, round(p_adjusted, 6) as p_adjusted) from adjusted""",
        "session_pairs": f"""with ev as (select distinct user_id::varchar || ':' || ts::date::varchar as id, event_type as item from events), {_pair_sql()} select item_a, item_b, n11, n_a, n_b, n from pairs""",
        "network_edges": f"with {_NET} select * exclude (odds_ratio) replace (round(p_value, 6) as p_value, round(p_adjusted, 6) as p_adjusted) from edges",
        "network_nodes": f"with {_NET} select item, k as n, round(k::double / n, 6) as prevalence from cnt, tot where item in (select item from ends)",
        "node_degree_strength": f"with {_NET} select item, count(*) as degree, round(sum(weight), 6) as strength from ends group by item",
        "node_clustering": f"""with {_NET}, deg as (select item, count(*) as k from ends group by item),
tri as (select a.item, count(*) as t from ends a join ends b on a.item = b.item and a.other < b.other join edges x on x.item_a = a.other and x.item_b = b.other group by a.item)
select item, coalesce(t, 0) as triangles, round(case when k < 2 then 0 else 2.0::double * coalesce(t, 0) / (k * (k - 1)) end, 6) as clustering from deg left join tri using (item)""",
        "partition_modularity": f"""with {_NET}, {_DOMINANT}, m as (select sum(weight) as m2 from ends),
d as (select community, sum(weight) as d from ends join dom using (item) group by community),
l as (select p.community, sum(weight) as l from edges join dom p on p.item = item_a join dom q on q.item = item_b and p.community = q.community group by p.community)
select round(coalesce(sum(2 * coalesce(l, 0) / m2 - power(d / m2, 2)), 0), 6) + 0 as modularity from d left join l using (community), m""",
        "partition_ari": f"""with {_docs()}, {_DOMINANT}, c as (select community, substr(item, 1, 1) as letter, count(*) as k from dom group by all),
s as (select sum(k * (k - 1) / 2) as s, sum(k) as n from c), a as (select sum(k * (k - 1) / 2) as sa from (select sum(k) as k from c group by community)),
b as (select sum(k * (k - 1) / 2) as sb from (select sum(k) as k from c group by letter))
select n::bigint as n, round((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) as ari from s, a, b""",
        "network_shared_edges": f"with {_side_sql('x', SIDES[0])}, {_side_sql('y', SIDES[1])} select item_a, item_b, x.weight as weight_a, y.weight as weight_b from x join y using (item_a, item_b)",
        "network_only_edges": f"with {_side_sql('x', SIDES[0])}, {_side_sql('y', SIDES[1])} select item_a, item_b, weight from x anti join y using (item_a, item_b)",
        "compare_strata": f"""with {_side_rules_sql("x", SIDES[0])}, {_side_rules_sql("y", SIDES[1])}, first as (select min(p_type) as item from part where p_partkey in (select l_partkey from lineitem))
select rule_key, round(x.support, 6) as group_building_support, round(x.lift, 6) as group_building_lift, x.n as group_building_n,
  round(y.support, 6) as group_machinery_support, round(y.lift, 6) as group_machinery_lift, y.n as group_machinery_n,
  case when list_contains(list_append(coalesce(x.lhs, y.lhs), coalesce(x.rhs, y.rhs)), first.item) then 'group_specific_item'
    when x.n is not null and y.n is not null then 'universal' when x.n is not null then 'group_building_only' else 'group_machinery_only' end as category
from x full join y using (rule_key), first""",
        "stratified_rules": _STRATA_RULES,
        "eb_priors": f"with {_baskets()}, {_trans()}, nt as (select count(distinct id) as n from t) select item, round(10 * count(*)::double / any_value(n) + 1, 6) as a, round(10 * (1 - count(*)::double / any_value(n)) + 1, 6) as b from t, nt group by item",
        "em_single_step": f"""with {_baskets()}, {_trans()}, idx as (select item, row_number() over (order by item) - 1 as i from (select distinct item from t)),
par as (select item, k, ({_THETA})::double as th from idx, (select unnest([0, 1]) as k)), base as (select k, sum(ln(1 - th)) as b from par group by k),
ll as (select id, k, sum(ln(th) - ln(1 - th)) as v from t join par using (item) group by id, k), z as (select id, k, v + b as z from ll join base using (k)),
r as (select id, k, exp(z - max(z) over (partition by id)) / sum(exp(z - mx)) over (partition by id) as r from (select *, max(z) over (partition by id) as mx from z)),
nk as (select k, sum(r) as nk from r group by k), tt as (select sum(nk) as total from nk), s as (select k, item, sum(r) as s from r join t using (id) group by k, item)
select (k + 1)::bigint as cluster, item, round(nk / total, 6) as pi, round(s / nk, 6) as theta from s join nk using (k), tt""",
        "hdp_category_rules": f"""with w(cluster, beta_weight, g, pi) as (values {", ".join(f"({c}::bigint, {b}::double, '{g}', {p}::double)" for c, b, g, p in _PI)}),
p as (select cluster, beta_weight, count(*) filter (pi > 0.05) as k, count(*) as n, string_agg(lower(g), '_and_' order by lower(g)) filter (pi > 0.05) as names, max(pi) as hi, min(pi) as lo from w group by all)
select cluster, beta_weight, case when beta_weight <= 0.01 then 'negligible' when k = n and hi / greatest(lo, 1e-8) < 2 then 'universal' when k = n then 'both_present_but_unequal'
  when k = 0 then 'negligible' else 'group_' || names || '_only' end as category from p""",
        "upset_intersections": f"""with {_baskets("p_type")}, {_trans()}, c as (select id, string_agg(item, ' + ' order by item) as combination from t group by id)
select combination, count(*) as n from c group by combination having count(*) >= 5 order by n desc, combination limit 100""",
        "item_prevalence": f"""with {_baskets()}, a as (select count(distinct id) as n, count(distinct id) filter (g = 'AUTOMOBILE') as x, count(distinct id) filter (g = 'BUILDING') as y from e)
select item, round(100.0::double * count(distinct id) / any_value(n), 6) as overall, round(100.0::double * count(distinct id) filter (g = 'AUTOMOBILE') / any_value(x), 6) as "group_AUTOMOBILE",
  round(100.0::double * count(distinct id) filter (g = 'BUILDING') / any_value(y), 6) as "group_BUILDING" from e, a group by item order by count(distinct id) desc, item limit 30""",
        "phi_matrix": f"with {_baskets()}, {_trans()}, {_pair_sql('t')} select item_a, item_b, round({PHI}, 6) as phi from pairs",
        "rule_matrix": f"""with {_RULES}, m as (select least(lhs[1], rhs) as item_a, greatest(lhs[1], rhs) as item_b, max(lift) as v from rules where len(lhs) = 1 group by all)
select item_a, item_b, round(v, 6) as value from m union all select item_b, item_a, round(v, 6) from m""",
    }
