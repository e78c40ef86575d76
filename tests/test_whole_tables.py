"""Registered queries on tables larger than the driver's."""

import math
import random

import pytest

from braidframe.errors import KeyConflict
from braidframe.operators import Table, store
from braidframe.operators.store import automatic_key
from braidframe.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["sort_up", "sort_up_null_low", "sort_down", "sort_down_null_low"])
def test_sorts_keep_all_rows(spark, tmp_path, name):
    spark.range(1500).selectExpr("cast(id as int) n_nationkey", "concat('n', id) n_name", "cast(id % 5 as int) n_regionkey", "'' n_comment").write.parquet(f"{tmp_path}/nation.parquet")
    rows = QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(r.rn for r in rows) == list(range(1, 1501))
    low, falling = name.endswith("null_low"), name.startswith("sort_down")
    key = lambda r: ((r.k is None) != (low != falling), (0 if r.k is None else -r.k if falling else r.k), r.n_nationkey)
    assert [r.rn for r in sorted(rows, key=key)] == list(range(1, 1501))


def _nodes(plan):
    yield plan
    below = plan.children()
    for i in range(below.size()):
        yield from _nodes(below.apply(i))


def _windows_sort_all_rows(df):
    """Whether rows reach a window without being aggregated first."""
    windows = [n for n in _nodes(df._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Window"]
    assert windows
    return any(all(n.nodeName() != "Aggregate" for n in _nodes(w)) for w in windows)


@pytest.mark.parametrize("flag", ["+", "+!", "-", "-!"])
@pytest.mark.parametrize("mode", ["groups", "range"])
@pytest.mark.parametrize("kind", ["int", "decimal(12,2)", "double"])
def test_few_large_window_groups(spark, flag, mode, kind):
    """A frame of values sorts a group's distinct values in one task, not its rows."""
    data = [(i, (0, 1, None)[i % 3], None if i % 11 == 0 else i * 7 % 13) for i in range(900)]
    table = Table(spark.createDataFrame(data, "id int, g int, v int").selectExpr("id", "g", f"cast(v as {kind}) v"), ("id",), ("id",))
    names = ("count", "sum", "min", "max", "avg", "first", "last")
    frame = f"{mode}:-2..1"
    out = table.derive(f"{{g; {flag}v, id, {', '.join(f'{n}_ = {n}(v, {frame})' for n in names)}}}").df
    assert not _windows_sort_all_rows(out)
    got = {r.id: r for r in out.collect()}
    assert len(got) == 900
    for g in (0, 1, None):
        own = {r[0]: r[2] for r in data if r[1] == g}
        falling, nulls_first = flag.startswith("-"), flag.endswith("!") != flag.startswith("-")
        values = sorted({v for v in own.values() if v is not None}, reverse=falling)
        values = [None, *values] if None in own.values() and nulls_first else [*values, None] if None in own.values() else values
        for i, v in own.items():
            at = values.index(v)
            framed = values[max(0, at - 2) : at + 2] if mode == "groups" else [x for x in values if (x is None) == (v is None) and (v is None or v - 2 <= x <= v + 1)]
            rows = [x for x in framed for y in own.values() if x == y]
            there = [x for x in rows if x is not None]
            want = (len(there), sum(there), min(there, default=None), max(there, default=None), sum(there) / len(there) if there else None, rows[0], rows[-1])
            r = got[i]
            assert r.v == v and (r.count_, r.sum_, r.min_, r.max_, r.first_, r.last_) == (*want[:4], *want[5:])
            assert r.avg_ is None and want[4] is None or abs(float(r.avg_) - want[4]) < 1e-5


def test_win_groups_windows_hold_distinct_values(spark):
    assert not _windows_sort_all_rows(QUERIES["win_groups"](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("bits", [14, 5])
@pytest.mark.parametrize("low, high", [(1, 899), (-450, 449), (-(1 << 63), (1 << 63) - 1)])
def test_automatic_keys_beside_a_table_in_one_pass(spark, monkeypatch, bits, low, high):
    """However many numbers are taken, rows get the first free ones without another join for each try."""
    monkeypatch.setattr(store, "_BITS", bits, raising=False)
    zero, draw = low <= 0 <= high, random.Random(3)
    span = high - low + 1 - zero
    step = next(x for x in iter(lambda: draw.randrange(1, span + 1), None) if math.gcd(x, span) == 1)
    shift = draw.randrange(span)
    keys = [(i * step + shift) % span + low for i in range(min(span, 1200))]
    keys = [k + 1 if zero and k >= 0 else k for k in keys]
    taken = set(keys[:700:2]) | set(keys[40:80])
    table = spark.createDataFrame([(k,) for k in [*taken, keys[0], 0, None]], "k long")
    out = automatic_key(spark.range(500).withColumnRenamed("id", "v"), "k", low, high, seed=3, table=table)
    assert sum(n.nodeName() == "Join" for n in _nodes(out._jdf.queryExecution().optimizedPlan())) <= (0 if bits == 14 else 4)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert out.columns == ["v", "k"] and sorted(r.v for r in rows) == list(range(500))
    assert {r.k for r in rows} == set([k for k in keys if k not in taken][:500])


def test_automatic_keys_fill_all_that_are_free(spark):
    rows = spark.range(60).selectExpr("id v", "id k")
    table = spark.range(-20, 21).withColumnRenamed("id", "k")
    assert sorted(r.k for r in automatic_key(rows, "k", -50, 50, table=table).collect()) == [k for k in range(-50, 51) if abs(k) > 20]
    with pytest.raises(KeyConflict):
        automatic_key(rows, "k", -50, 49, table=table)
