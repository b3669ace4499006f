import pytest

from kinfold.functions import schema
from kinfold.operators import mining, prep
from kinfold.sources import io
from tests.fixtures import EXCLUSIVE, SCHEMA, fifty


@pytest.fixture(scope="module")
def ev(spark):
    return spark.createDataFrame(fifty(), SCHEMA).persist()


def test_fixture_shape(ev):
    summary = prep.record_summary(ev).collect()
    assert len(summary) == 50 and ev.count() == 70
    assert sum(len(r["items"]) > 1 for r in summary) == 20
    assert all(r["n_items"] >= len(r["items"]) and list(r["items"]) == sorted(r["items"]) for r in summary)


@pytest.mark.parametrize("arguments, n", [({}, 20), ({"group": "A"}, 6), ({"group": "B"}, 14), ({"min_items": 1}, 50)])
def test_transactions(ev, arguments, n):
    assert prep.transactions(ev, **arguments).count() == n


@pytest.mark.parametrize("timing, window, n", [("concurrent", 0, 18), ("sequential", 0, 2), ("concurrent", 5, 20), ("sequential", 5, 0)])
def test_timing(ev, timing, window, n):
    assert prep.transactions(ev, timing=timing, window=window).count() == n


def test_timing_of_rows(ev):
    assert prep.filter_by_timing(ev, "concurrent").count() == 36
    assert prep.filter_by_timing(ev, "sequential").count() == 4
    assert prep.filter_by_timing(ev).count() == 70


def test_unknown_timing(ev):
    with pytest.raises(ValueError):
        prep.transactions(ev, timing="never")
    with pytest.raises(ValueError):
        prep.filter_by_timing(ev, "never")
    with pytest.raises(ValueError):
        prep.filter_by_timing(ev.drop("year"), "concurrent")


def test_exclusive_items(ev):
    a = prep.filter_group(ev, "A", EXCLUSIVE)
    assert a.filter("item like 'GB%'").count() == 0 and a.filter("item = 'GA1'").count() == 13
    both = prep.filter_group(ev, "A", {"A": {"GA1"}, "B": {"GA1"}})
    assert both.filter("item = 'GA1'").count() == 0
    assert prep.filter_group(ev, None, EXCLUSIVE).count() == 70


def test_one_hot(ev):
    wide = prep.one_hot(prep.transactions(ev))
    items = [c for c in wide.columns if c != "id"]
    assert items == sorted(items) and wide.count() == 20
    assert wide.filter("Item01 and Item02").count() == 10


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    trans = prep.transactions(none)
    assert trans.count() == 0 and mining.association_rules(trans, min_count=1).count() == 0
    assert mining.frequent_itemsets(trans).count() == 0


def test_itemsets(ev):
    trans = prep.transactions(ev)
    found = {tuple(r["items"]): r for r in mining.frequent_itemsets(trans, min_count=5).collect()}
    assert found[("Item01", "Item02")].support == 0.5 and found[("Item01", "Item02")].n == 10
    assert ("Item03", "Item04") not in found


def test_min_count_is_whole(spark):
    rows = [(i, x, "A", 1) for i in range(58) for x in (("a", "b") if i < 30 else ("c", "d"))]
    trans = prep.transactions(spark.createDataFrame(rows, SCHEMA))
    for find in (lambda: mining.frequent_itemsets(trans, min_count=30), lambda: mining.fp_growth_itemsets(trans, 30)):
        assert [list(r["items"]) for r in find().collect()] == [["a", "b"]]


def test_rules(ev):
    trans = prep.transactions(ev)
    r = {(tuple(x.lhs), x.rhs): x for x in mining.association_rules(trans, min_count=5).collect()}[(("Item02",), "Item01")]
    assert (r.support, r.confidence, r.coverage, r.n, r.length) == (0.5, 1.0, 0.5, 10, 2)
    assert r.lift == pytest.approx(1 / (13 / 20))


def test_schema_checks(spark):
    bad = spark.createDataFrame([(None, "a", "A", 1)], SCHEMA)
    with pytest.raises(Exception, match="null id"):
        schema.events(bad).collect()
    with pytest.raises(ValueError):
        schema.events(bad.drop("item"))
    assert schema.Vocabulary(item="Drug").item_lc == "drug"


def test_sources(spark, ev, tmp_path):
    import pyarrow as pa

    table = ev.toArrow()
    with pa.OSFile(str(tmp_path / "e.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as out:
        out.write_table(table)
    assert io.read_events(spark, str(tmp_path / "e.arrow")).count() == 70
    io.write_csv(ev, str(tmp_path / "c.csv"))
    again = io.read_events(spark, str(tmp_path / "c.csv"))
    assert sorted(again.columns) == sorted(ev.columns) and again.count() == 70
    io.write_parquet(ev, str(tmp_path / "p"))
    assert io.read_events(spark, str(tmp_path / "p")).count() == 70
    assert io.union_by_name(ev, ev.drop("year")).filter("year is null").count() == 70
    assert io.normalized("﻿my col!") == "my_col"
