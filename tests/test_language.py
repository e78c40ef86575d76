"""The query language against brute force in Python."""

import itertools
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidframe.errors import KeyConflict, QueryError, UnsetColumn
from braidframe.lang import parse_expression, parse_query
from braidframe.lang.nodes import Binary, Literal, conjuncts, negated
from braidframe.operators import State, Table, View, concat, join, join_identity, kv
from braidframe.operators.join import parse_spec
from braidframe.operators.store import MappedState, automatic_key, sorter
from braidframe.sources import Database


def rows(table):
    df = table.df if isinstance(table, Table) else table
    return [tuple(r) for r in df.collect()]


# parsing


def shape(n):
    if isinstance(n, Binary):
        return f"({shape(n.left)} {n.op} {shape(n.right)})"
    return str(n.value) if isinstance(n, Literal) else getattr(n, "name", type(n).__name__)


def test_precedence():
    assert shape(parse_expression("a || b && c | d ^ e & f == g < h + i * j")) == "(a || (b && (c | (d ^ (e & (f == (g < (h + (i * j)))))))))"
    assert shape(parse_expression("1 - 2 - 3")) == "((1 - 2) - 3)"
    assert shape(parse_expression("a & 3 == 1")) == "(a & (3 == 1))"


@pytest.mark.parametrize(("text", "kind", "value"), [("7", "int", 7), ("7L", "long", 7), ("0x1F", "int", 31), ("5_000_000_000", "long", 5_000_000_000), ("1g", "big", 1), ("1.5g", "decimal", Decimal("1.5")), ("1.5f", "float", 1.5), ("2d", "double", 2.0), ("1e3", "double", 1000.0), (".5", "double", 0.5), ("'a\\n\\'b'", "string", "a\n'b"), ('"x"', "string", "x"), ("true", "boolean", True), ("null", "null", None), ("-2147483648", "int", -2147483648), ("99999999999999999999", "big", 99999999999999999999)])
def test_literals(text, kind, value):
    node = parse_expression(text)
    assert (node.kind, node.value) == (kind, value)


@pytest.mark.parametrize("text", ["{a", "{a, }", "{a b}", "a ==", "a = 1", "{*, ~}", "'open", "a # b", "{a.b = 1}", "?0 == 1", "?101 == 1", "f(x:1, 2)", "{+*}", "()"])
def test_syntax_errors(text):
    with pytest.raises(QueryError):
        parse_query(text)


def test_query_parts():
    q = parse_query("{a, ~b = x + 1, +!c, d.e.*; s = sum(x, rows:-1..), *} a == ? && b > ?3")
    assert [(i.path.name, i.hidden, i.order, i.wild) for i in q.first] == [("a", False, None, False), ("b", True, None, False), ("c", False, "+!", False), ("d.e", False, None, True)]
    assert q.second[0].expr.named[0][0] == "rows" and q.second[1].wild and q.arguments == 3
    assert len(conjuncts(q.filter)) == 2
    assert shape(negated(parse_expression("a < 1 && b == 2"))) == "((a >= 1) || (b != 2))"


# null logic

OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def high(x):
    return (1, 0) if x is None else (0, x)


@pytest.fixture(scope="module")
def pairs(spark):
    values = [None, -1, 0, 5]
    data = [(i, a, b, a if a is not None else 9, None if a is None else a > 0) for i, (a, b) in enumerate(itertools.product(values, values))]
    df = spark.createDataFrame(data, "id int, a int, b int, c int, t boolean")
    return Table(df, ("id",), ("c",)), data


@pytest.mark.parametrize("op", OPS)
def test_comparisons(pairs, op):
    table, data = pairs
    cases = {f"a {op} b": (1, 2), f"a {op} c": (1, 3), f"c {op} b": (3, 2)}
    text = "{id, " + ", ".join(f"x{k} = {e}, y{k} = !({e})" for k, e in enumerate(cases)) + f", k = a {op} 0, n = a {op} null, m = null {op} b}}"
    out = {r[0]: r[1:] for r in rows(table.derive(text))}
    for r in data:
        want = []
        for i, j in cases.values():
            v = OPS[op](high(r[i]), high(r[j]))
            want += [v, not v]
        want += [OPS[op](high(r[1]), high(0)), OPS[op](high(r[1]), high(None)), OPS[op](high(None), high(r[2]))]
        assert list(out[r[0]]) == want, (op, r)
    for k, (i, j) in enumerate(cases.values()):
        got = {r[0] for r in rows(table.derive(list(cases)[k]))}
        assert got == {r[0] for r in data if OPS[op](high(r[i]), high(r[j]))}


def test_boolean_and_in(pairs):
    table, data = pairs
    assert {r[0] for r in rows(table.derive("{id} t"))} == {r[0] for r in data if r[4]}
    assert {r[0] for r in rows(table.derive("{id} !t"))} == {r[0] for r in data if not r[4] and r[4] is not None}
    assert {r[0] for r in rows(table.derive("{id} a in ?", [5, None]))} == {r[0] for r in data if r[1] in (5, None)}
    assert {r[0] for r in rows(table.derive("{id} !(a in ?)", [5]))} == {r[0] for r in data if r[1] != 5}
    assert rows(table.derive("{id} a in ?", None)) == [] == rows(table.derive("{id} a in ?", []))
    assert len(rows(table.derive("a == a && !(a != a)"))) == len(data)
    assert {r[0] for r in rows(table.derive("{id} a == '5'"))} == {r[0] for r in data if r[1] == 5}
    with pytest.raises(QueryError):
        table.derive("a < 'x'")
    with pytest.raises(QueryError):
        table.derive("nothing == 1")
    with pytest.raises(QueryError):
        table.derive("a == ?")
    with pytest.raises(QueryError):
        table.derive("a + 1")


# arithmetic


def test_arithmetic(spark):
    one = join_identity(spark)
    out = one.derive("{a = -7 / 2, b = -7 % 3, c = 7.0 / 0.0, d = -1.0 / 0, e = 0.0 / 0.0, f = 5.0 % 0.0, g = 6 & 3 | 8, h = 6 ^ 3, i = true ^ false, j = 1 + 2L, k = 1.5f + 1, l = 'x', m = null, n = 3 * 1.5g, o = coalesce(null, 3, 'x'), p = iif(null == 1, 1, 2.5), q = 10g / 4g}").df.first().asDict()
    assert (out["a"], out["b"], out["c"], out["d"]) == (-3, -1, math.inf, -math.inf)
    assert math.isnan(out["e"]) and math.isnan(out["f"])
    assert (out["g"], out["h"], out["i"], out["j"], out["k"], out["l"], out["m"], out["n"], out["o"], out["p"]) == (10, 5, True, 3, 2.5, "x", None, Decimal("4.5"), "3", 2.5)
    types = {f.name: f.dataType for f in one.derive("{a = 1 / 2, b = 1L + 1, c = 1f + 1f, d = 1f + 1, e = 1g + 1}").df.schema.fields}
    assert types == {"a": T.IntegerType(), "b": T.LongType(), "c": T.FloatType(), "d": T.DoubleType(), "e": T.DecimalType(38, 0)}
    for text in ("{x = 2147483647 + 1}", "{x = 1 / 0}", "{x = 9223372036854775807 * 2}"):
        with pytest.raises(Exception, match="(?i)overflow|divi"):
            one.derive(text).df.collect()
    for text in ("{x = 'a' + 1}", "{x = true + 1}", "{x = 1.5 & 1}", "{x = coalesce()}", "{x = iif(1, 2, 3)}", "{x = nope(1)}", "{x = -'a'}", "{x = 1..2}"):
        with pytest.raises(QueryError):
            one.derive(text)
    r = one.derive("{a = random(), b = random(10), c = random(5L, 7L), ~x = random(), y = x, z = x}").df.first()
    assert 0 <= r.a < 1 and 0 <= r.b < 10 and 5 <= r.c < 7 and r.y == r.z


# projection


def test_projection(spark):
    t = Table(spark.createDataFrame([(1, "x", (2, "in"))], "a int, b string, s struct<p int, q string>"), ("a",))
    assert t.derive("{b, *}").columns == ["b", "a", "s"]
    assert t.derive("{*, ~b}").columns == ["a", "s"]
    assert t.derive("{s.*, a}").columns == ["a", "s.p", "s.q"] and rows(t.derive("{s.p, s.q}")) == [(2, "in")]
    assert rows(t.derive("{~x = a + 1, y = x * x, z = y + x} z == 6")) == [(4, 6)]
    assert t.derive("{}").columns == [] and t.derive("{}").df.count() == 1
    assert rows(t.derive("{b = a + 1, c = b * 2}")) == [(2, 4)]
    for bad in ("{a, a}", "{a, a = 1}", "{zz}", "{a.p}", "{b.*}"):
        with pytest.raises(QueryError):
            t.derive(bad)
    with pytest.raises(UnsetColumn):
        t.get(t.derive("{b}").df.first(), "a")
    assert t.load(a=1).b == "x" and t.try_load(a=2) is None and t.exists(a=1) and not t.is_empty()
    with pytest.raises(KeyError):
        t.load(a=5)


# grouping


def test_grouping(spark):
    data = [(i, ["p", "q", None][i % 3], [None, 4, 1, 7][i % 4], i * 1.5) for i in range(24)]
    t = Table(spark.createDataFrame(data, "id long, g string, v int, d double"), ("id",))
    got = {r[0]: r[1:] for r in rows(t.derive("{g; n = count(), k = count(v), s = sum(v), lo = min(v), hi = max(v), m = avg(v), f = first(v), l = last(id)}"))}
    for g in ("p", "q", None):
        own = [r for r in data if r[1] == g]
        v = [r[2] for r in own if r[2] is not None]
        assert got[g] == (len(own), len(v), sum(v), min(v), max(v), pytest.approx(sum(v) / len(v)), own[0][2], own[-1][0])
    by_v = {r[0]: r[1] for r in rows(t.derive("{g; -v, w = first(id)}"))}
    for g in by_v:
        own = sorted((r for r in data if r[1] == g), key=lambda r: (r[2] is not None, -(r[2] or 0), r[0]))
        assert by_v[g] == own[0][0]
    assert rows(t.derive("{; n = count()} id < 0")) == []
    assert rows(t.derive("{; s = sum(v), a = avg(v), m = min(v), k = count(v)} v == null")) == [(0, None, None, 0)]
    assert sorted(r[0] for r in rows(t.derive("{m = id % 5L; n = count()} n > 4 && id >= 0"))) == [0, 1, 2, 3]
    assert [r[1] for r in rows(t.derive("{g; -s = sum(id)}"))] == sorted((sum(r[0] for r in data if r[1] == g) for g in ("p", "q", None)), reverse=True)
    assert [r[0] for r in rows(t.derive("{-g; n = count()}"))] == [None, "q", "p"]
    kinds = {f.name: f.dataType for f in t.derive("{; a = sum(v), b = sum(id), c = sum(d), d = avg(v)}").df.schema.fields}
    assert kinds == {"a": T.LongType(), "b": T.DecimalType(38, 0), "c": T.DoubleType(), "d": T.DoubleType()}
    for bad in ("{g; v, n = count()}", "{g; n = count(), -v}", "{g; x = sum(sum(v))}", "{g; x = sum(g)}", "{x = sum(v)}", "{g; a = sum(v), b = sum(v, rows:..)}", "{g; a = sum()}", "{x = count(); }", "{g; a = sum(v), a = 1}"):
        with pytest.raises(QueryError):
            t.derive(bad)


# windows


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(4)
    data = [(i, rng.randint(1, 4), rng.randint(-4, 4), rng.choice([None, *range(-3, 4)]), rng.randint(-3, 3)) for i in range(60)]
    return Table(spark.createDataFrame(data, "id long, g int, b int, c int, d int"), ("id",)), data


def frames(own, mode, low, high, at):
    """Indexes in the frame of row ``at`` of ordered rows; low and high are functions of the row."""
    r = own[at]
    lo, hi = (f(r) if f else None for f in (low, high))
    if mode == "rows":
        return [j for j in range(len(own)) if (lo is None or j >= at + lo) and (hi is None or j <= at + hi)]
    if mode == "groups":
        run = [0]
        for a, b in itertools.pairwise(own):
            run.append(run[-1] + (a[2] != b[2]))
        return [j for j in range(len(own)) if (lo is None or run[j] >= run[at] + lo) and (hi is None or run[j] <= run[at] + hi)]
    return [j for j in range(len(own)) if (lo is None or own[j][2] >= r[2] + lo) and (hi is None or own[j][2] <= r[2] + hi)]


CASES = [("rows", -2, 1), ("rows", 1, 3), ("rows", -3, -1), ("rows", None, 0), ("rows", 0, None), ("rows", None, None), ("groups", -1, 1), ("groups", 1, 2), ("groups", None, 0), ("range", -2, 1.5), ("range", 1, None), ("range", None, -1), ("rows", "c", "d"), ("rows", "-2", "d"), ("groups", "d", "1"), ("range", "d", "2")]


@pytest.mark.parametrize("flag", ["+", "-"])
@pytest.mark.parametrize(("mode", "low", "high"), CASES)
def test_windows(wide, mode, low, high, flag):
    table, data = wide
    variable = isinstance(low, str)
    if variable:
        low, high = {"c": "coalesce(c, 0)"}.get(low, low), {"c": "coalesce(c, 0)"}.get(high, high)
    frame = f"{mode}:{'' if low is None else low}..{'' if high is None else high}"
    text = f"{{g; {flag}b, id, n = count({frame}), k = count(b, {frame}), s = sum(b, {frame}), lo = min(b, {frame}), hi = max(b, {frame}), a = avg(b, {frame})}}".replace("count(rows:", "count(b, rows:") if mode == "rows" else f"{{g; {flag}b, id, n = count(b, {frame}), k = count(b, {frame}), s = sum(b, {frame}), lo = min(b, {frame}), hi = max(b, {frame}), a = avg(b, {frame})}}"

    def bound(x):
        if x is None:
            return None
        if not variable:
            return lambda r: x
        return {"coalesce(c, 0)": lambda r: r[3] or 0, "d": lambda r: r[4]}.get(x, lambda r: int(x) if x.lstrip("-").isdigit() else 0)

    got = {r[2]: r[3:] for r in rows(table.derive(text))}
    for g in {r[1] for r in data}:
        own = sorted((r for r in data if r[1] == g), key=lambda r: (r[2] if flag == "+" else -r[2], r[0]))
        for i, r in enumerate(own):
            v = [own[j][2] for j in frames(own, mode, bound(low), bound(high), i)]
            want = (len(v), len(v), sum(v), min(v, default=None), max(v, default=None), pytest.approx(sum(v) / len(v)) if v else None)
            assert got[r[0]] == want, (r, v)


def test_window_first_last(wide):
    table, data = wide
    got = {r[2]: r[3:] for r in rows(table.derive("{g; +b, id, f = first(c, rows:-2..0), l = last(c, rows:0..2), p = first(id, rows:-1..-1), n = last(id, rows:1..1), v = first(id, rows:d..5), w = last(id, rows:-5..d)}"))}
    for g in {r[1] for r in data}:
        own = sorted((r for r in data if r[1] == g), key=lambda r: (r[2], r[0]))
        n = len(own)
        for i, r in enumerate(own):
            first, last = (lambda k: own[max(0, min(n - 1, k))]), (lambda k: own[max(0, min(n - 1, k))])
            assert got[r[0]][:4] == (first(i - 2)[3], last(i + 2)[3], first(i - 1)[0], last(i + 1)[0])
            if i + r[4] <= n - 1 and r[4] <= 5:
                assert got[r[0]][4] == first(i + r[4])[0]


def test_long_variable_frames(spark):
    """Frames of up to thousands of rows are made of blocks of several levels."""
    rng = random.Random(21)
    data = [(i, i % 2 if i % 7 else None, rng.randrange(-50, 50) if i % 11 else None, rng.randrange(-700, 300), rng.randrange(-300, 900)) for i in range(3000)]
    t = Table(spark.createDataFrame(data, "id int, g int, v int, lo int, hi int"), ("id",), ("id", "lo", "hi"))
    frames_ = {"rows": "rows:lo..hi", "open": "rows:..hi", "groups": "groups:lo..hi", "range": "range:lo..hi"}
    for mode, frame in frames_.items():
        by_row = mode in ("rows", "open")
        x = "v" if by_row else "k"
        calls = ", ".join(f"{n} = {fn}({x}, {frame})" for n, fn in zip("csalhpq", ("count", "sum", "avg", "min", "max", "first", "last"), strict=True))
        got = {r["id"]: r for r in t.derive("{*, k = id / 3}").derive(f"{{g; {'+id' if by_row else '+k, id'}, {calls}}}").df.collect()}
        assert len(got) == 3000
        for part in (0, 1, None):
            mine = [r for r in data if r[1] == part]
            groups = {k: n for n, k in enumerate(sorted({r[0] // 3 for r in mine}))}
            places = [n if by_row else groups[r[0] // 3] if mode == "groups" else r[0] // 3 for n, r in enumerate(mine)]
            for n in range(0, len(mine), 17):
                r, row = mine[n], got[mine[n][0]]
                low = 0 if mode == "open" else places[n] + r[3]
                held = [y[2] if by_row else y[0] // 3 for y, at in zip(mine, places, strict=True) if low <= at <= places[n] + r[4]]
                values = [y for y in held if y is not None]
                assert (row["c"], row["s"], row["l"], row["h"]) == (len(values), sum(values), min(values, default=None), max(values, default=None)), (mode, r)
                assert row["a"] is None if not values else abs(row["a"] - sum(values) / len(values)) < 1e-9
                if held:
                    assert (row["p"], row["q"]) == (held[0], held[-1])


def test_window_rules(wide):
    table, data = wide
    assert len(rows(table.derive("{g; q = 1, id}"))) == len(data)
    assert rows(table.derive("{; +id, n = count(rows:..0)} n <= 3 && id >= 10")) == [(i, i - 9) for i in (10, 11, 12)]
    for bad in ("{g; +b, x = sum(c, range:-1..1)}", "{g; x = sum(b, range:-1..1)}", "{g; +b, x = sum(b, rows:1)}", "{g; +b, x = sum(b, rows:0.5..1)}", "{g; +b, x = sum(b, rows:-1..1, groups:0..0)}", "{g; +b, x = sum(b, rows:'a'..1)}"):
        with pytest.raises(QueryError):
            table.derive(bad)


# joins


@pytest.fixture(scope="module")
def company(spark):
    departments = [(31, "Sales", 1), (33, "Engineering", 2), (34, "Clerical", 1), (35, "Marketing", 2)]
    employees = [(1001, "Rafferty", "Australia", 31), (1002, "Jones", "Australia", 33), (1003, "Heisenberg", "Australia", 33), (1004, "Robinson", "United States", 34), (1005, "Smith", "Germany", 34), (1006, "Williams", "Germany", None)]
    companies = [(1, "Hooli"), (2, "Initech"), (3, "Home")]
    return {
        "emp": (Table(spark.createDataFrame(employees, "id int, lastName string, country string, departmentId int"), ("id",)), employees),
        "dept": (Table(spark.createDataFrame(departments, "id int, name string, companyId int"), ("id",)), departments),
        "comp": (Table(spark.createDataFrame(companies, "id long, name string"), ("id",)), companies),
    }


JOINS = {":": "inner", "::": "inner", ">:": "left", ":<": "right", ">:<": "full", ">": "left_anti", "<": "right_anti", "><": "full_anti"}


def slow_join(kind, left, right, left_only, right_only, on):
    left, right = [x for x in left if left_only(x)], [y for y in right if right_only(y)]
    pairs = [(x, y) for x in left for y in right if on(x, y)]
    lonely = [(x, None) for x in left if not any(on(x, y) for y in right)], [(None, y) for y in right if not any(on(x, y) for x in left)]
    out = [] if kind.endswith("anti") else pairs
    if kind in ("left", "full", "left_anti", "full_anti"):
        out = out + lonely[0]
    if kind in ("right", "full", "right_anti", "full_anti"):
        out = out + lonely[1]
    return out


@pytest.mark.parametrize("op", JOINS)
@pytest.mark.parametrize("flt", [0, 1, 2, 3])
def test_joins(company, op, flt):
    emp, dept = company["emp"], company["dept"]
    terms = ["emp.departmentId == dept.id", "dept.name != 'Sales'", "emp.country != 'Germany'", "emp.id >= dept.id"]
    text = " && ".join(terms[: flt + 1])
    got = join(f"emp {op} dept", emp=emp[0], dept=dept[0]).derive(text).df.collect()
    left_only = (lambda x: x[2] != "Germany") if flt >= 2 else lambda x: True
    right_only = (lambda y: y[1] != "Sales") if flt >= 1 else lambda y: True
    want = slow_join(JOINS[op], emp[1], dept[1], left_only, right_only, lambda x, y: x[3] == y[0])
    key = lambda p: str(p)
    assert sorted(((r.emp and tuple(r.emp), r.dept and tuple(r.dept)) for r in got), key=key) == sorted(want, key=key)


def test_join_shapes(company, spark):
    emp, dept, comp = (company[n][0] for n in ("emp", "dept", "comp"))
    assert join("emp : dept", emp, dept).df.count() == 24
    assert join("emp >: dept", emp, dept).derive("emp.id < 0").df.count() == 0
    names = rows(join("(emp >: dept) >: comp", emp, dept, comp).derive("{emp.lastName, company = comp.name} emp.departmentId == dept.id && dept.companyId == comp.id"))
    assert sorted(names, key=str) == sorted([("Rafferty", "Hooli"), ("Jones", "Initech"), ("Heisenberg", "Initech"), ("Robinson", "Hooli"), ("Smith", "Hooli"), ("Williams", None)], key=str)
    nested = rows(join("comp >: (dept : emp)", comp=comp, dept=dept, emp=emp).derive("{c = comp.name; n = count(emp.id)} dept.companyId == comp.id && emp.departmentId == dept.id"))
    assert sorted(nested) == [("Home", 0), ("Hooli", 3), ("Initech", 2)]
    pairs = rows(join("a : b", emp, emp).derive("{x = a.id, y = b.id} a.departmentId == b.departmentId && a.id < b.id"))
    assert sorted(pairs) == [(1002, 1003), (1004, 1005)]
    assert sorted(rows(join("a : b", emp, emp).derive("{x = a.id, y = b.id} a.departmentId == b.departmentId && a.departmentId == null"))) == [(1006, 1006)]
    left = join("emp >: dept", emp, dept).derive("emp.departmentId == dept.id")
    assert left.df.schema["dept"].nullable and [r.emp.id for r in left.df.where("dept is null").collect()] == [1006]
    for bad in ("emp >", "(emp : dept", "emp : emp", "emp ! dept", "", ": emp"):
        with pytest.raises(QueryError):
            parse_spec(bad)
    with pytest.raises(QueryError):
        join("a : b", emp)
    with pytest.raises(QueryError):
        join("a : b", emp, dept).derive("c.id == 1")
    assert join_identity(spark).df.count() == 1


def test_join_prunes_and_pushes(spark):
    sf = "/root/testdata/sf0.001"
    db = Database(spark, sf).declare("nation", ("n_nationkey",), ("n_name", "n_regionkey")).declare("region", ("r_regionkey",), ("r_name",))
    plan = db.join("nation : region").explain("{n = nation.n_name} nation.n_regionkey == region.r_regionkey && region.r_name == 'ASIA'")
    assert "EqualTo(r_name,ASIA)" in plan and "ReadSchema: struct<n_name:string,n_regionkey:int>" in plan
    plan = db.open_table("nation").explain("{n_name} n_nationkey > 3")
    assert "GreaterThan(n_nationkey,3)" in plan and "- filter: 1 term" in plan


# sets, conversions, views, changes


def test_concat(spark):
    a = Table(spark.createDataFrame([(1, 5, 6, None)], "id long, a int, b int, c long"), ("id",), ("a", "b"))
    b = Table(spark.createDataFrame([(2, "x", "y")], "id int, b string, d string"), ("id",), ("b", "d"))
    out = concat(a, b)
    assert out.columns == ["id", "a", "b", "c", "d"] and sorted(rows(out), key=str) == [(1, 5, "6", None, ""), (2, 0, "x", None, "y")]
    assert rows(concat(a, a).derive("{a}").distinct()) == [(5,)]
    with pytest.raises(QueryError):
        concat(a.derive("{a}"), Table(spark.createDataFrame([(True,)], "a boolean")))


def test_conversions(spark):
    t = Table(spark.createDataFrame([(5_000_000_000, "12.9", 1e30, None, [1, 300], "true", 0.5)], "a long, b string, c double, d int, e array<int>, f string, g double"), (), ("a",))
    target = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.ByteType(), False), T.StructField("c", T.LongType(), False), T.StructField("d", T.LongType(), False), T.StructField("e", T.ArrayType(T.ByteType()), False), T.StructField("f", T.BooleanType(), False), T.StructField("g", T.BooleanType(), False), T.StructField("h", T.StringType(), False), T.StructField("i", T.StringType())])
    assert rows(t.as_type(target)) == [(2147483647, 12, 9223372036854775807, 0, [1, 127], True, False, "", None)]
    assert rows(t.derive("{a = 7L}").as_exact(T.StructType([T.StructField("a", T.IntegerType())]))) == [(7,)]
    with pytest.raises(Exception, match="(?i)without loss|overflow"):
        rows(t.as_exact(T.StructType([T.StructField("a", T.IntegerType())])))
    with pytest.raises(QueryError):
        t.derive_as(T.StructType([T.StructField("a", T.LongType())]), "{a, b}")


def test_orders(spark):
    t = Table(spark.createDataFrame([(1, None), (2, "b"), (3, "a"), (4, None)], "id int, s string"), ("id",))
    want = {"+": [3, 2, 1, 4], "-": [1, 4, 2, 3], "+!": [1, 4, 3, 2], "-!": [2, 3, 1, 4]}
    for flag, ids in want.items():
        assert [r[0] for r in rows(t.derive(f"{{id, {flag}s}}"))] == ids
        assert [r[0] for r in rows(t.sorted(f"{flag}s"))] == ids
    assert [r[0] for r in rows(t.derive("{id, ~-id}"))] == [4, 3, 2, 1]
    assert [r[0] for r in rows(t.skip(-1, "+id"))][::-1] == [1, 2, 3] and [r[0] for r in rows(t.skip(3, "+id"))] == [4]
    assert [r[0] for r in rows(t.seek("lt", id=3))] == [2] and rows(t.seek("gt", id=4)) == []


def test_views(spark):
    a = View(spark.createDataFrame([(b"a", 1), (b"b", 2), (b"\xff", 3)], "key binary, value int"))
    b = View(spark.createDataFrame([(b"b", 20), (b"c", 30)], "key binary, value int"))
    plain = lambda v: sorted((bytes(k), x) for k, x in rows(v.df))
    assert plain(a.union(b)) == [(b"a", 1), (b"b", 2), (b"c", 30), (b"\xff", 3)]
    assert plain(a.union(b, kv.discard)) == [(b"a", 1), (b"c", 30), (b"\xff", 3)]
    assert plain(a.intersection(b, lambda k, x, y: x + y)) == [(b"b", 22)] and plain(a.difference(b)) == [(b"a", 1), (b"\xff", 3)]
    assert plain(a.difference(b, kv.second)) == [(b"a", 1), (b"b", 20), (b"\xff", 3)]
    assert [bytes(k) for k, _ in rows(a.reverse().scan())] == [b"\xff", b"b", b"a"] and a.count(b"b") == 2
    assert plain(a.prefix(b"b", 1)) == [(b"", 2)] and a.load(b"a") == 1 and a.load(b"z") is None and a.exists(b"b")
    assert plain(a.store(b.df)) == [(b"a", 1), (b"b", 20), (b"c", 30), (b"\xff", 3)] and plain(a.insert(b.df)) == [(b"a", 1), (b"b", 2), (b"c", 30), (b"\xff", 3)]
    assert plain(a.replace(b.df)) == [(b"a", 1), (b"b", 20), (b"\xff", 3)] and plain(a.update(b"a", 1, 9).lt(b"b")) == [(b"a", 9)]
    assert plain(a.delete(b.df)) == [(b"a", 1), (b"\xff", 3)] and plain(a.ge(b"b").filtered(lambda k, v: v < 3)) == [(b"b", 2)]


def test_changes(spark):
    make = lambda data: spark.createDataFrame(data, "id int, name string, n int")
    s = State(Table(make([(1, "a", 10), (2, "b", 20)]), ("id",), ("name",)), [("name",)])
    assert sorted(rows(s.store(make([(2, "c", 5), (3, "d", None)])).df)) == [(1, "a", 10), (2, "c", 5), (3, "d", None)]
    with pytest.raises(KeyConflict):
        s.insert(make([(2, "z", 1)]))
    with pytest.raises(KeyConflict):
        s.insert(make([(9, "a", 1)]))
    assert sorted(rows(s.try_insert(make([(2, "z", 1), (3, "y", 1)])).df)) == [(1, "a", 10), (2, "b", 20), (3, "y", 1)]
    with pytest.raises(KeyError):
        s.replace(make([(7, "z", 1)]))
    some = spark.createDataFrame([(1, 99)], "id int, n int")
    assert sorted(rows(s.update(some).df)) == [(1, "a", 99), (2, "b", 20)]
    with pytest.raises(KeyError):
        s.update(spark.createDataFrame([(8, 99)], "id int, n int"))
    assert rows(s.merge(some)[1]) == [(1, "a", 99)] and rows(s.exchange(make([(1, "q", 0)]))[1]) == [(1, "a", 10)]
    left, gone = s.delete_all("n > ?", 15)
    assert rows(left.df) == [(1, "a", 10)] and gone == 1
    assert rows(s.delete(spark.createDataFrame([(1,)], "id int")).df) == [(2, "b", 20)]
    view = State(Table(make([(1, "a", 10)]), ("id",)), view="n > 5")
    with pytest.raises(QueryError):
        view.store(make([(2, "b", 1)]))
    assert all(1 <= r[0] <= 9 for r in rows(automatic_key(make([(1, "a", 1)] * 20), "id", 1, 9)))
    assert rows(sorter([make([(2, "x", 1), (1, "y", 1)]), make([(2, "z", 2)])], ["id"])) == [(1, "y", 1), (2, "z", 2)]


def test_merged_aggregates(spark, monkeypatch):
    from braidframe.operators import hooks

    monkeypatch.setattr(hooks, "HELD_STATES", 3)
    t = Table(spark.createDataFrame([(i, i % 5 if i % 6 else None, f"x{i % 2}") for i in range(100)], "id int, a int, b string"), ("id",))
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("s", T.LongType())])
    for by in (("a", "b"), ()):
        end = lambda s, k: {"a": k[0] if k else None, "b": k[1] if k else None, "s": s}
        one = rows(t.aggregate(by, lambda r: r.id, lambda s, r: s + r.id, end, schema, ("id",)))
        two = rows(t.aggregate(by, lambda r: r.id, lambda s, r: s + r.id, end, schema, ("id",), merge=lambda x, y: x + y))
        assert sorted(one, key=str) == sorted(two, key=str) and sum(r[2] for r in two) == 4950


def test_keys_of_the_resulting_state(spark):
    make = lambda data: spark.createDataFrame(data, "a int, b int")
    s = State(Table(make([(1, 5), (2, 6)]), ("a",), ("b",)), [("b",)])
    assert sorted(rows(s.try_insert(make([(2, 9), (3, 5), (4, 7), (5, 7), (4, 8)])).df)) == [(1, 5), (2, 6), (4, 7)]
    for clash in ([(3, 9), (4, 9)], [(3, 7), (3, 8)], [(3, 5)], [(1, 9)]):
        with pytest.raises(KeyConflict):
            s.insert(make(clash))
    assert sorted(rows(s.store(make([(1, 6), (2, 5)])).df)) == [(1, 6), (2, 5)]
    assert sorted(rows(s.update(make([(1, 6), (2, 5)])).df)) == [(1, 6), (2, 5)]
    with pytest.raises(KeyConflict):
        s.store(make([(7, 6)]))
    with pytest.raises(KeyConflict):
        s.try_update(make([(1, 6)]))
    with pytest.raises(KeyConflict):
        s.update_all("a == 1", b=F.lit(6))
    # a row that is left out does not keep others out
    two = State(Table(spark.createDataFrame([], "k int, a int, b int"), ("k",)), [("a",), ("b",)])
    chain = spark.createDataFrame([(1, 1, 9), (2, 2, 9), (3, 2, 3), (4, None, 4), (5, None, 5)], "k int, a int, b int")
    assert sorted(rows(two.try_insert(chain).df)) == [(1, 1, 9), (3, 2, 3), (4, None, 4)]


def test_changes_through_a_view(spark):
    make = lambda data: spark.createDataFrame(data, "a int, b int")
    s = State(Table(make([(1, 5), (2, 500)]), ("a",)), view="b < ?", view_args=(100,))
    for verb in (s.store, s.insert, s.try_insert, s.update, s.try_update, s.merge, s.replace):
        with pytest.raises(QueryError):
            verb(make([(1 if verb not in (s.insert, s.try_insert) else 3, 500)]))
    with pytest.raises(QueryError):
        s.update_all("", b=F.lit(100))
    with pytest.raises(QueryError):
        s.store(make([(2, 7)]))
    with pytest.raises(KeyError):
        s.update(make([(2, 7)]))
    assert sorted(rows(s.try_update(make([(1, 6), (2, 7)])).df)) == [(1, 6), (2, 500)]
    assert rows(s.try_merge(make([(1, 6), (2, 7), (9, 1)]))[1]) == [(1, 6)]
    assert sorted(rows(s.delete(make([(1, 0), (2, 0)])).df)) == [(2, 500)]
    left, gone = s.delete_all()
    assert rows(left.df) == [(2, 500)] and gone == 1


def test_changes_through_a_mapped_table(spark):
    source = State(Table(spark.createDataFrame([(1, "123", 5), (2, "7", 6)], "id long, str string, num int"), ("id",)))
    forward = lambda df: df.select("id", F.col("num").cast("string").alias("str"), F.col("str").cast("int").alias("num"))
    inverse = {"id": "id", "str": lambda df: F.col("num").cast("string"), "num": lambda df: F.expr("try_cast(str as int)")}
    make = lambda data: spark.createDataFrame(data, "id long, str string, num int")
    shut = MappedState(source, forward, inverse)
    for verb in (shut.store, shut.insert, shut.update, shut.delete):
        with pytest.raises(QueryError):
            verb(make([(1, "1", 1)]))
    swapped = MappedState(source, forward, inverse, store=lambda df: F.col("num").isNotNull(), update="num != null", delete="")
    assert sorted(rows(swapped.store(make([(3, "8", 9)])).df)) == [(1, "5", 123), (2, "6", 7), (3, "8", 9)]
    for verb in (swapped.store, swapped.update):
        with pytest.raises(QueryError):
            verb(make([(1, "hello", 9)]))
    changed = swapped.update(spark.createDataFrame([(1, "99")], "id long, str string"))
    assert sorted(rows(changed.source.df)) == [(1, "123", 99), (2, "7", 6)]
    assert rows(swapped.delete(make([(1, "", 0)])).source.df) == [(2, "7", 6)]
    with pytest.raises(KeyConflict):
        swapped.insert(make([(1, "8", 9)]))


def test_automatic_keys(spark):
    df = spark.range(500).withColumnRenamed("id", "v").repartition(7)
    for low, high in ((1, 500), (-250, 250), (1, (1 << 63) - 1), (-(1 << 63), (1 << 63) - 1)):
        got = [r[1] for r in rows(automatic_key(df, "k", low, high, seed=3))]
        assert len(set(got)) == 500 and 0 not in got and all(low <= k <= high for k in got)
    taken = spark.range(1, 400).withColumnRenamed("id", "k")
    got = [r[1] for r in rows(automatic_key(df, "k", 1, 899, seed=3, table=taken))]
    assert sorted(got) == list(range(400, 900))
    with pytest.raises(KeyConflict):
        automatic_key(df, "k", 1, 898, table=taken)


def test_seek_on_several_columns(spark):
    t = Table(spark.createDataFrame([(a, b) for a in range(3) for b in (1, 3, 5)], "a int, b int"), ("a", "b"))
    seek = lambda how, **k: rows(t.seek(how, **k))
    assert seek("ge", a=1, b=2) == [(1, 3)] and seek("gt", a=1, b=5) == [(2, 1)] and seek("le", a=1, b=0) == [(0, 5)] and seek("lt", a=0, b=1) == []
    assert seek("first") == [(0, 1)] and seek("last") == [(2, 5)] and seek("eq", a=2, b=3) == [(2, 3)] and seek("ge", a=1) == [(1, 1)]
    assert rows(t.random_row("a == 1 && b > 3")) == [(1, 5)]


def test_restore(spark, tmp_path):
    db = Database(spark, str(tmp_path / "one"))
    db.save("t", Table(spark.range(5).toDF("k")))
    db.backup(str(tmp_path / "copy"))
    other = Database(spark, str(tmp_path / "two"))
    other.restore(str(tmp_path / "copy"))
    assert sorted(rows(other.open_table("t").df)) == [(k,) for k in range(5)]
    with pytest.raises(KeyError):
        other.restore(str(tmp_path / "copy"))


def test_database(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}").declare("t", ("id",))
    t = Table(spark.createDataFrame([(1, "a")], "id int, s string"), ("id",))
    db.save("t", t)
    assert db.names() == ["t"] and db.open_table("t").key == ("id",) and db.find_table("u") is None
    db.rename("t", "u")
    db.backup(f"file://{tmp_path}/copy")
    assert db.names() == ["u"] and Database(spark, f"file://{tmp_path}/copy").names() == ["u"]
    assert db.open_table("v", T.StructType([T.StructField("x", T.IntegerType())])).is_empty()
    db.delete("u")
    with pytest.raises(KeyError):
        db.open_table("u")


def test_hooks(spark):
    t = Table(spark.createDataFrame([(i, i % 3, i * i) for i in range(12)], "id int, g int, v int"), ("id",))
    schema = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("s", T.IntegerType())])
    assert sorted(rows(t.aggregate(("g",), lambda r: r.v, lambda s, r: s + r.v, lambda s, k: {"g": k[0], "s": s} if k[0] else None, schema))) == [(g, sum(i * i for i in range(12) if i % 3 == g)) for g in (1, 2)]
    assert rows(t.group((), "-id", lambda rs: ({"g": r.id, "s": n} for n, r in zip(range(2), rs, strict=False)), schema)) == [(11, 0), (10, 1)]
    mapped = t.map(lambda r: {"g": r.g, "s": r.v} if r.id > 2 else None, schema, inverse={"g": "g"})
    assert sorted(rows(mapped.derive("g == 0 && s > 10"))) == [(0, 36), (0, 81)]


def test_stream(spark, tmp_path):
    from braidframe.streaming import apply_batches, derive_stream

    spark.range(10).selectExpr("id", "id * 2 as v").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, v long").parquet(f"{tmp_path}/in")
    out = []
    q = apply_batches(derive_stream(stream, "{id, w = v + 1L} id >= ?", 7), lambda df, n: out.extend(tuple(r) for r in df.collect()), f"{tmp_path}/state")
    q.awaitTermination(60)
    assert sorted(out) == [(7, 15), (8, 17), (9, 19)]
    with pytest.raises(QueryError):
        derive_stream(stream, "{+id}")
    assert F is not None


def test_row_boxes(spark):
    from braidframe.operators.rows import RowBox, changes

    df = spark.createDataFrame([(1, "7", 2.5, (3,)), (2, "x", 4.0, None)], "id int, s string, d double, r struct<p int>")
    box = RowBox.of(df.schema, df.where("id = 1").first())
    assert box.get("s", "int") == 7 and box["r.p"] == 3 and box.get("d", "decimal") == Decimal("2.5") and box.changed() == set()
    for name, kind in (("d", "int"), ("s", "boolean")):
        with pytest.raises(ValueError, match=name):
            box.get(name, kind)
    box["d"] = 9.0
    other = box.clone()
    assert box.changed() == {"d"} and other["d"] == 9.0
    other.unset("s")
    assert not other.is_set("s") and box.is_set("s") and [n for n, _ in other] == ["id", "d", "r"]
    with pytest.raises(UnsetColumn):
        other["s"]
    with pytest.raises(QueryError):
        box["zz"] = 1
    state = State(Table(df, ("id",)))
    assert [r.d for r in state.update(changes([box], df, ("id",))).df.orderBy("id").collect()] == [9.0, 4.0]
    box.clean()
    seen = []
    box.for_each(lambda n, v: seen.append(n))
    assert seen == ["id", "s", "d", "r"] and box.changed() == set()
    empty = RowBox(df.schema)
    box.copy_to(empty)
    assert empty["id"] == 1
