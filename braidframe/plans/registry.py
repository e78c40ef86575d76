"""Registered queries over the driver's tables, each with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as Y
from ..operators import State, Table, View, concat, join, join_identity
from ..operators import kv
from ..operators.rows import RowBox
from ..operators.store import MappedState, automatic_key, delete_scanned, sorter, update_scanned
from ..sources import Database

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",),
}
#: Columns that hold no null in the driver's tables, which Parquet does not say.
NON_NULL = {
    "nation": ("n_name", "n_regionkey"), "region": ("r_name",), "customer": ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "supplier": ("s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "orders": ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("ts", "user_id", "event_type", "value"),
}

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return Table(spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS.get(name, ()), NON_NULL.get(name, ()))


class Loader:
    """Gives tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> Table:
        return load(self.spark, self.sf_dir, name)

    def database(self) -> Database:
        db = Database(self.spark, self.sf_dir)
        for name, key in KEYS.items():
            db.declare(name, key, NON_NULL.get(name, ()))
        return db

    def values(self, schema: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)


def _plain(df: DataFrame) -> DataFrame:
    """Whole decimals as longs, the other ones as doubles, for comparison with SQL."""
    return df.select(*(F.col(f"`{f.name}`").cast("long" if f.dataType.scale == 0 else "double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def query(sql: str | None) -> Callable[[Callable], Callable]:
    """Register a function of a loader; ``sql`` is its equivalent."""

    def register(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Loader(spark, sf_dir))
            return _plain(out.df if isinstance(out, Table) else out)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def simple(name: str, table: str, text: str, sql: str | None, *args: object, rounded: dict[str, int] | None = None) -> None:
    """Register one ``derive`` on one table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = load(spark, sf_dir, table).derive(text, *args).df
        for c, digits in (rounded or {}).items():
            df = df.withColumn(c, F.round(c, digits))
        return _plain(df)

    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


#: A customer table with nulls: no balance for debtors.
_NULLED = "{c_custkey, c_nationkey, bal = iif(c_acctbal < 0.0, null, c_acctbal), other = iif(c_nationkey > 20, null, c_acctbal)}"
_NULLED_SQL = "(SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal, CASE WHEN c_nationkey > 20 THEN NULL ELSE c_acctbal END AS other FROM customer)"

# aggregation

simple(
    "agg_group", "lineitem", "{l_returnflag, l_linestatus; n = count(), qty = sum(l_quantity), low = min(l_discount), high = max(l_extendedprice), price = avg(l_extendedprice)} l_discount > ?",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, min(l_discount) AS low, max(l_extendedprice) AS high, round(avg(l_extendedprice), 4) AS price FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2",
    0.05, rounded={"price": 4},
)
simple("agg_global", "lineitem", "{; n = count(), parts = max(l_partkey), lines = sum(l_linenumber)}", "SELECT count(*) AS n, max(l_partkey) AS parts, sum(l_linenumber)::BIGINT AS lines FROM lineitem")
simple("agg_global_empty", "lineitem", "{; n = count(), s = sum(l_linenumber)} l_quantity < 0.0", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0")
simple("agg_expr_key", "lineitem", "{m = l_orderkey % 7L, line = l_linenumber; n = count(), s = sum(l_partkey)}", "SELECT l_orderkey % 7 AS m, l_linenumber AS line, count(*) AS n, sum(l_partkey)::BIGINT AS s FROM lineitem GROUP BY 1, 2")
simple("agg_having", "orders", "{o_custkey; n = count(), top = max(o_totalprice)} n >= 12 && o_orderstatus != 'P'", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) >= 12")
simple("agg_first_last", "orders", "{o_custkey; +o_orderdate, f = first(o_orderkey), l = last(o_orderkey), p = last(o_orderpriority)}", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS f, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS l, last(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS p FROM orders GROUP BY 1")
simple("agg_first_falling", "orders", "{o_orderpriority; -o_orderdate, -o_orderstatus, f = first(o_orderkey)}", "SELECT o_orderpriority, first(o_orderkey ORDER BY o_orderdate DESC, o_orderstatus DESC, o_orderkey) AS f FROM orders GROUP BY 1")
simple("agg_order_groups", "orders", "{-o_orderpriority; n = count(), +s = sum(o_custkey)}", "SELECT o_orderpriority, count(*) AS n, sum(o_custkey)::BIGINT AS s FROM orders GROUP BY 1")
simple("agg_hidden_group", "orders", "{~o_orderstatus; n = count(), twice = n * 2L}", "SELECT count(*) AS n, 2 * count(*) AS twice FROM orders GROUP BY o_orderstatus")
simple("agg_group_only", "customer", "{c_mktsegment; }", "SELECT c_mktsegment FROM customer")
simple("agg_expression", "lineitem", "{l_linenumber; spread = max(l_quantity) - min(l_quantity), per = sum(l_quantity) / count()}", "SELECT l_linenumber, max(l_quantity) - min(l_quantity) AS spread, round(sum(l_quantity) / count(*), 6) AS per FROM lineitem GROUP BY 1", rounded={"per": 6})


@query(f"SELECT c_nationkey, count(*) AS n, count(bal) AS k, coalesce(sum(CASE WHEN bal > 9000 THEN 1 END), 0)::BIGINT AS rich, min(bal) AS low, max(other) AS high, coalesce(round(sum(other), 2), 0) AS total FROM {_NULLED_SQL} GROUP BY 1")
def agg_nulls(t):
    out = t("customer").derive(_NULLED).derive("{c_nationkey; n = count(), k = count(bal), rich = sum(iif(bal > 9000.0 && bal != null, 1, null)), low = min(bal), high = max(other), total = sum(other)}")
    return out.df.withColumn("total", F.round("total", 2))


@query("SELECT c_mktsegment, count(*) AS nations FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer) GROUP BY 1")
def agg_count_distinct(t):
    return t("customer").derive("{c_mktsegment, c_nationkey}").distinct().derive("{c_mktsegment; nations = count()}")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey = 7 GROUP BY 1")
def agg_key_lookup(t):
    return t("orders").derive("{o_custkey; n = count()}").derive("o_custkey == ?", 7)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(t):
    return t("lineitem").derive("{l_returnflag, l_linestatus, l_linenumber}").distinct()


# filters

for _n, _op, _sql in (
    ("eq", "bal == other", "bal IS NOT DISTINCT FROM other"), ("ne", "bal != other", "bal IS DISTINCT FROM other"),
    ("gt", "bal > other", "coalesce(bal > other, bal IS NULL AND other IS NOT NULL)"), ("ge", "bal >= other", "coalesce(bal >= other, bal IS NULL)"),
    ("lt", "bal < other", "coalesce(bal < other, other IS NULL AND bal IS NOT NULL)"), ("le", "bal <= other", "coalesce(bal <= other, other IS NULL)"),
    ("gt_const", "bal > 5000.0", "bal > 5000 OR bal IS NULL"), ("le_const", "bal <= 5000.0", "bal <= 5000"), ("is_null", "bal == null", "bal IS NULL"), ("not_null", "bal != null", "bal IS NOT NULL"),
    ("not", "!(bal > other && c_nationkey < 10) || !(bal == null)", "NOT (coalesce(bal > other, bal IS NULL AND other IS NOT NULL) AND c_nationkey < 10) OR bal IS NOT NULL"),
    ("true", "true", "true"), ("false", "1 == 2", "false"),
):

    def _filter(t, op=_op):
        return t("customer").derive(_NULLED).derive(op)

    _filter.__name__ = f"filter_{_n}"
    query(f"SELECT * FROM {_NULLED_SQL} WHERE {_sql}")(_filter)

simple("filter_string_number", "nation", "n_nationkey == '7' || n_name == 3", "SELECT * FROM nation WHERE n_nationkey::VARCHAR = '7' OR n_name = '3'")
simple("filter_in", "nation", "n_regionkey in ? && !(n_nationkey in ?)", "SELECT * FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 12)", [1, 3], [2, 12])
simple("filter_expression", "lineitem", "l_quantity * (1.0 - l_discount) > l_tax * 500.0 && (l_linenumber & 1) == 1", "SELECT * FROM lineitem WHERE l_quantity * (1.0 - l_discount) > l_tax * 500.0 AND (l_linenumber & 1) = 1")
simple("filter_time", "orders", "{o_orderkey, o_orderdate} o_orderdate >= '1997-01-01 00:00:00'", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'")
simple("filter_args", "orders", "{o_orderkey} o_custkey > ?2 && o_custkey < ?1 || o_orderkey == ?", "SELECT o_orderkey FROM orders WHERE o_custkey > 10 AND o_custkey < 30 OR o_orderkey = 30", 30, 10)
simple("range_scan", "orders", "{o_orderkey, o_custkey} o_orderkey >= 100 && o_orderkey < 300", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300")
simple("range_union", "orders", "{o_orderkey} o_orderkey < 50 || o_orderkey >= 400 && o_orderkey <= 450", "SELECT o_orderkey FROM orders WHERE o_orderkey < 50 OR (o_orderkey >= 400 AND o_orderkey <= 450)")
simple("disjoint_union", "customer", "{c_custkey} c_nationkey == 3 || c_mktsegment == 'BUILDING'", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_mktsegment = 'BUILDING'")
simple("load_one", "orders", "o_orderkey == 17", "SELECT * FROM orders WHERE o_orderkey = 17")


@query("SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderpriority = '1-URGENT' AND o_custkey < 500")
def view_of_view(t):
    return t("orders").derive("o_totalprice > ?", 100000.0).derive("o_orderpriority == ? && o_custkey < ?", "1-URGENT", 500)


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def predicate(t):
    table = t("customer")
    return table.df.where(table.predicate("c_acctbal > ?", 9000.0)).select("c_custkey")


@query("SELECT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9990) AS rich, NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = 5) AS none")
def exists(t):
    table = t("customer")
    return table.df.sparkSession.createDataFrame([(table.any_rows("c_acctbal > ?", 9990.0), not table.exists(c_custkey=5))], "rich boolean, none boolean")


@query("SELECT * FROM nation WHERE false")
def empty_table(t):
    return t("nation").empty()


# projection

simple("proj_columns", "part", "{p_partkey, p_size}", "SELECT p_partkey, p_size FROM part")
simple("proj_wildcard", "nation", "{twice = n_nationkey * 2, *}", "SELECT n_nationkey * 2 AS twice, * FROM nation")
simple("proj_exclude", "part", "{*, ~p_name, ~p_type}", "SELECT * EXCLUDE (p_name, p_type) FROM part")
simple("proj_computed", "part", "{p_partkey, total = p_retailprice * 2.0 + 1.0, big = p_size > 25}", "SELECT p_partkey, p_retailprice * 2.0 + 1.0 AS total, p_size > 25 AS big FROM part")
simple("proj_variable", "part", "{p_partkey, ~x = p_size + 1, y = x * x, z = y - x} z > 100", "SELECT p_partkey, (p_size + 1) * (p_size + 1) AS y, (p_size + 1) * (p_size + 1) - (p_size + 1) AS z FROM part WHERE (p_size + 1) * (p_size + 1) - (p_size + 1) > 100")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey > 3")
def proj_path(t):
    rows = Table(t("customer").df.select("c_custkey", F.struct("c_name", "c_nationkey").alias("who")), ("c_custkey",))
    return rows.derive("{c_custkey, who.*} who.c_nationkey > 3").df.toDF("c_custkey", "c_name", "c_nationkey")


# expressions

simple("expr_int_div", "lineitem", "{l_orderkey, l_linenumber, d = l_partkey / 7L, m = (l_partkey - 500L) % 7L, n = (l_partkey - 500L) / 7L}", "SELECT l_orderkey, l_linenumber, l_partkey // 7 AS d, (l_partkey - 500) % 7 AS m, trunc((l_partkey - 500) / 7)::BIGINT AS n FROM lineitem")
simple("expr_arithmetic", "part", "{p_partkey, a = p_partkey + p_size, b = p_partkey - 3 * p_size, c = -p_size, d = p_retailprice / 4.0, e = p_retailprice % 7.0}", "SELECT p_partkey, p_partkey + p_size AS a, p_partkey - 3 * p_size AS b, -p_size AS c, p_retailprice / 4.0 AS d, round(p_retailprice % 7.0, 6) AS e FROM part", rounded={"e": 6})
simple("expr_float_div_zero", "part", "{p_partkey, inf = iif(p_retailprice / (p_size % 2 * 1.0) > 1e300, 1, 0)}", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS inf FROM part")
simple("expr_bitwise", "part", "{p_partkey, a = p_size & 6, o = p_size | 8, x = p_size ^ 5, both = (p_size > 10) ^ (p_size > 20), any = (p_size > 40) | (p_size < 5), all = (p_size > 10) & (p_size < 20)}", "SELECT p_partkey, p_size & 6 AS a, p_size | 8 AS o, xor(p_size, 5) AS x, (p_size > 10) <> (p_size > 20) AS both, (p_size > 40) OR (p_size < 5) AS any, (p_size > 10) AND (p_size < 20) AS all FROM part")
simple("expr_literals", "region", "{r_regionkey, h = 0x1f, l = 5_000_000_000, f = 1.5f, d = 2e3, s = 'it\\'s', q = \"x\", t = true}", "SELECT r_regionkey, 31::INTEGER AS h, 5000000000::BIGINT AS l, 1.5::FLOAT AS f, 2000.0::DOUBLE AS d, 'it''s' AS s, 'x' AS q, true AS t FROM region")
simple("expr_iif_coalesce", "customer", "{c_custkey, w = iif(c_acctbal > 5000.0, 'rich', c_mktsegment), k = coalesce(iif(c_nationkey > 12, null, c_nationkey), -1), m = coalesce(iif(c_nationkey > 12, null, c_nationkey), 'none')}", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE c_mktsegment END AS w, coalesce(CASE WHEN c_nationkey > 12 THEN NULL ELSE c_nationkey END, -1) AS k, coalesce(CASE WHEN c_nationkey > 12 THEN NULL ELSE c_nationkey::VARCHAR END, 'none') AS m FROM customer")
simple("expr_boolean_column", "nation", "{n_name, low = n_nationkey < 10 && n_regionkey != 2, no = !(n_nationkey < 10)}", "SELECT n_name, n_nationkey < 10 AND n_regionkey <> 2 AS low, NOT (n_nationkey < 10) AS no FROM nation")
simple("expr_zero_times_null", "customer", "{c_custkey, z = 0 * iif(c_nationkey > 5, null, c_nationkey), k = iif(c_nationkey > 5, null, c_nationkey) * 2}", "SELECT c_custkey, 0 AS z, CASE WHEN c_nationkey > 5 THEN NULL ELSE c_nationkey END * 2 AS k FROM customer")
simple("expr_random", "part", "{p_partkey, ok = random(10) < 10, x = random() < 1.0, y = random(5, 7) >= 5}", "SELECT p_partkey, true AS ok, true AS x, true AS y FROM part")


@query("SELECT a.vec_id, a.embedding < b.embedding AS low FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def array_compare(t):
    table = t("embeddings")
    pivot = Table(table.df.where("vec_id = 0"), ("vec_id",))
    return join("a : p", table, pivot).derive("{id = a.vec_id, low = a.embedding < p.embedding}").df.toDF("vec_id", "low")


@query("SELECT 6 * 7 AS x, 'a' AS y")
def identity_scalar(t):
    return join_identity(t("region").df.sparkSession).derive("{x = 6 * 7, y = 'a'}")


@query("SELECT least(p_partkey * 10000000, 2147483647)::INTEGER AS p_partkey, 0 AS p_name, p_size::VARCHAR AS p_size, p_retailprice >= 1 AS p_retailprice, '' AS extra FROM part")
def convert_lossy(t):
    target = T.StructType([T.StructField("p_partkey", T.IntegerType(), False), T.StructField("p_name", T.IntegerType(), False), T.StructField("p_size", T.StringType(), False), T.StructField("p_retailprice", T.BooleanType(), False), T.StructField("extra", T.StringType(), False)])
    return t("part").derive("{p_partkey = p_partkey * 10000000L, p_name, p_size, p_retailprice}").as_type(target)


@query("SELECT p_partkey::INTEGER AS p_partkey, p_size::BIGINT AS p_size FROM part")
def convert_exact(t):
    return t("part").derive_as(T.StructType([T.StructField("p_partkey", Y.INT, False), T.StructField("p_size", Y.LONG, False)]), "{p_partkey, p_size}")


# sorting

def _numbered(df: DataFrame) -> DataFrame:
    """The place of each row of a small sorted result, taken from its order."""
    return df.withColumn("rn", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


for _flag, _sql in (("+", "ASC NULLS LAST"), ("+!", "ASC NULLS FIRST"), ("-", "DESC NULLS FIRST"), ("-!", "DESC NULLS LAST")):

    def _sort(t, flag=_flag):
        rows = Table(t("nation").derive("{n_nationkey, k = iif(n_regionkey == 2, null, n_regionkey)}").df, ("n_nationkey",))
        return _numbered(rows.derive(f"{{n_nationkey, {flag}k}}").df)

    _sort.__name__ = "sort_" + {"+": "up", "+!": "up_null_low", "-": "down", "-!": "down_null_low"}[_flag]
    query(f"SELECT n_nationkey, k, row_number() OVER (ORDER BY k {_sql}, n_nationkey) AS rn FROM (SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey END AS k FROM nation)")(_sort)


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders QUALIFY rn <= 10")
def topk(t):
    return _numbered(t("orders").derive("{o_orderkey, o_totalprice}").top(10, "-o_totalprice+o_orderkey").df)


@query("SELECT n_nationkey FROM nation ORDER BY n_name OFFSET 20")
def skip_rows(t):
    return t("nation").skip(20, "+n_name").derive("{n_nationkey}")


@query("SELECT n_nationkey FROM nation ORDER BY n_name LIMIT 20")
def skip_back(t):
    return t("nation").skip(-5, "+n_name").derive("{n_nationkey}")


@query("SELECT * FROM (SELECT 'ge' AS how, min(o_orderkey) AS k FROM orders WHERE o_orderkey >= 333 UNION ALL SELECT 'lt', max(o_orderkey) FROM orders WHERE o_orderkey < 333 UNION ALL SELECT 'first', min(o_orderkey) FROM orders UNION ALL SELECT 'last', max(o_orderkey) FROM orders)")
def cursor_seek(t):
    orders = t("orders")
    found = [(how, orders.seek(how, **({"o_orderkey": 333} if how in ("ge", "lt") else {}))) for how in ("ge", "lt", "first", "last")]
    rows = [df.select(F.lit(how).alias("how"), F.col("o_orderkey").alias("k")) for how, df in found]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_regionkey DESC) AS rn FROM region")
def reverse_scan(t):
    return _numbered(t("region").scan(reverse=True).select("r_regionkey", "r_name"))


@query("SELECT n_regionkey, max(n_nationkey)::INTEGER AS n_nationkey FROM nation GROUP BY 1")
def sorter_last_wins(t):
    rows = t("nation").df.select("n_regionkey", "n_nationkey")
    top = rows.groupBy("n_regionkey").agg(F.max("n_nationkey").alias("n_nationkey"))
    return sorter([rows.where("n_nationkey < 5"), top], ["n_regionkey"])


# joins


def _company(t):
    n = t("customer").df.select(F.col("c_custkey").alias("n_nationkey"), F.col("c_name").alias("n_name"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey END").alias("n_regionkey"))
    r = t("supplier").df.select((F.col("s_suppkey") - 7).alias("r_regionkey"), F.col("s_name").alias("r_name"))
    return {"n": Table(n, ("n_nationkey",)), "r": Table(r, ("r_regionkey",))}


_N = "(SELECT c_custkey AS n_nationkey, c_name AS n_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey END AS n_regionkey FROM customer)"
_R = "(SELECT s_suppkey - 7 AS r_regionkey, s_name AS r_name FROM supplier)"
_PAIR = "{n = n.n_nationkey, r = r.r_name}"
for _n, _op, _sql in (
    ("inner", ":", "{N} n JOIN {R} r ON n.n_regionkey = r.r_regionkey"), ("straight", "::", "{N} n JOIN {R} r ON n.n_regionkey = r.r_regionkey"),
    ("left", ">:", "{N} n LEFT JOIN {R} r ON n.n_regionkey = r.r_regionkey"), ("right", ":<", "{N} n RIGHT JOIN {R} r ON n.n_regionkey = r.r_regionkey"),
    ("full", ">:<", "{N} n FULL JOIN {R} r ON n.n_regionkey = r.r_regionkey"),
    ("left_anti", ">", "{N} n LEFT JOIN {R} r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey IS NULL"), ("right_anti", "<", "{N} n RIGHT JOIN {R} r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey IS NULL"),
    ("full_anti", "><", "{N} n FULL JOIN {R} r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey IS NULL OR r.r_regionkey IS NULL"),
):

    def _join(t, op=_op):
        return join(f"n {op} r", **_company(t)).derive(_PAIR + " n.n_regionkey == r.r_regionkey")

    _join.__name__ = f"join_{_n}"
    query("SELECT n.n_nationkey AS n, r.r_name AS r FROM " + _sql.format(N=_N, R=_R))(_join)


@query("SELECT count(*) AS n FROM nation, region")
def join_cross(t):
    return join("n : r", t("nation"), t("region")).derive("{; n = count()}")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t):
    return join("a : b", t("nation"), t("nation")).derive("{x = a.n_nationkey, y = b.n_nationkey} a.n_regionkey == b.n_regionkey && a.n_nationkey < b.n_nationkey").df.toDF("a", "b")


@query("SELECT s.s_suppkey AS s, n.n_nationkey AS n FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey AND n.n_regionkey = 1")
def join_theta(t):
    return join("s : n", t("supplier"), t("nation")).derive("{s = s.s_suppkey, n = n.n_nationkey} s.s_nationkey < n.n_nationkey && n.n_regionkey == 1")


@query("SELECT n.n_nationkey AS n, r.r_regionkey AS r FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey OR n.n_nationkey = r.r_regionkey")
def join_or(t):
    return join("n : r", t("nation"), t("region")).derive("{n = n.n_nationkey, r = r.r_regionkey} n.n_regionkey == r.r_regionkey || n.n_nationkey == r.r_regionkey")


@query(f"SELECT n.n_nationkey AS n, r.r_name AS r FROM {_N} n LEFT JOIN {_R} r ON n.n_regionkey = r.r_regionkey AND r.r_name > 'Supplier#000000020' WHERE n.n_name > 'Customer#000000002'")
def join_on_placement(t):
    return join("n >: r", **_company(t)).derive(_PAIR + " n.n_regionkey == r.r_regionkey && r.r_name > 'Supplier#000000020' && n.n_name > 'Customer#000000002'")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END AS k FROM nation) a JOIN (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_keys(t):
    rows = Table(t("nation").df.select("n_nationkey", F.expr("CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END").alias("n_regionkey")), ("n_nationkey",))
    return join("a : b", rows, rows).derive("{x = a.n_nationkey, y = b.n_nationkey} a.n_regionkey == b.n_regionkey").df.toDF("a", "b")


@query("SELECT c.c_custkey AS c, n.n_name AS n, r.r_name AS r, o.o_orderkey AS o FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000 WHERE r.r_name = 'EUROPE'")
def join_multi(t):
    spec = "((c : n) : r) >: o"
    return join(spec, t("customer"), t("nation"), t("region"), t("orders")).derive("{c = c.c_custkey, n = n.n_name, r = r.r_name, o = o.o_orderkey} c.c_nationkey == n.n_nationkey && n.n_regionkey == r.r_regionkey && o.o_custkey == c.c_custkey && o.o_totalprice > 300000.0 && r.r_name == 'EUROPE'")


@query("SELECT r.r_name AS r, count(n.n_nationkey) AS n FROM region r LEFT JOIN (nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000) ON n.n_regionkey = r.r_regionkey GROUP BY 1")
def join_nested_aggregate(t):
    return join("r >: (n : s)", t("region"), t("nation"), t("supplier")).derive("{r = r.r_name; n = count(n.n_nationkey)} s.s_nationkey == n.n_nationkey && s.s_acctbal > 9000.0 && n.n_regionkey == r.r_regionkey")


@query("SELECT c.c_custkey AS c_custkey, c.c_name AS c_name, o.n AS n FROM customer c JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey WHERE o.n > 15")
def join_over_aggregate(t):
    counts = t("orders").derive("{o_custkey; n = count()}")
    return join("c : o", t("customer"), counts).derive("{k = c.c_custkey, name = c.c_name, n = o.n} o.o_custkey == c.c_custkey && o.n > 15").df.toDF("c_custkey", "c_name", "n")


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_wildcard(t):
    out = join("n : r", t("nation"), t("region")).derive("{n.*, r.r_name} n.n_regionkey == r.r_regionkey")
    return out.df.toDF("r_name", "n_nationkey", "n_name", "n_regionkey")


@query("SELECT n.n_nationkey AS k FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'")
def join_rows(t):
    joined = join("n : r", t("nation"), t("region")).derive("n.n_regionkey == r.r_regionkey")
    return joined.df.where("r.r_name = 'ASIA'").select(F.col("n.n_nationkey").alias("k"))


# windows

_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id {})"


def _events(name: str, frame: str, sql: str, flag: str = "+ts", bound: str = "rows") -> None:
    simple(
        name, "events", f"{{user_id; {flag}, event_id, n = count({bound}:{frame}), k = count(value, {bound}:{frame}), s = sum(event_id, {bound}:{frame}), low = min(value, {bound}:{frame}), high = max(value, {bound}:{frame})}}",
        f"SELECT user_id, ts, event_id, count(*) {sql} AS n, count(value) {sql} AS k, coalesce(sum(event_id) {sql}, 0)::BIGINT AS s, min(value) {sql} AS low, max(value) {sql} AS high FROM events",
    )


_events("win_rows", "-2..1", _W.format("ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING"))
_events("win_rows_before", "-3..-1", _W.format("ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING"))
_events("win_rows_after", "1..2", _W.format("ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING"))
_events("win_running", "..0", _W.format("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"))
_events("win_rest", "0..", _W.format("ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"))
_events("win_whole", "..", _W.format("ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"))
_events("win_falling", "-1..0", "OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)", flag="-ts")
simple("win_first_last", "events", "{user_id; +ts, event_id, f = first(event_id, rows:-2..0), l = last(event_id, rows:0..2), p = first(event_id, rows:-1..-1), x = last(event_id, rows:1..1)}", "SELECT user_id, ts, event_id, first(event_id) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f, last(event_id) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS l, coalesce(lag(event_id) OVER w, event_id) AS p, coalesce(lead(event_id) OVER w, event_id) AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
simple("win_avg", "events", "{user_id; +ts, event_id, a = avg(event_id, rows:-1..1)}", "SELECT user_id, ts, event_id, round(avg(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS a FROM events", rounded={"a": 6})
simple("win_filter", "events", "{user_id; +ts, event_id, n = count(rows:..0)} n <= 3 && event_type != 'view'", "SELECT user_id, ts, event_id, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type <> 'view') WHERE n <= 3")
simple("win_groups", "orders", "{o_orderpriority; +d = o_custkey / 10L, o_orderkey, n = count(d, groups:-1..1), s = sum(d, groups:-1..1), low = min(d, groups:-1..1)}", "SELECT o_orderpriority, o_custkey // 10 AS d, o_orderkey, count(*) OVER w AS n, (sum(o_custkey // 10) OVER w)::BIGINT AS s, min(o_custkey // 10) OVER w AS low FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_custkey // 10 GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
simple("win_range", "part", "{p_brand; +p_size, p_partkey, n = count(p_size, range:-5..2.5), s = sum(p_size, range:-5..2.5), high = max(p_size, range:-5..2.5)}", "SELECT p_brand, p_size, p_partkey, count(*) OVER w AS n, (sum(p_size) OVER w)::BIGINT AS s, max(p_size) OVER w AS high FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size::DOUBLE RANGE BETWEEN 5 PRECEDING AND 2.5 FOLLOWING)")
simple("win_range_falling", "part", "{p_brand; -p_size, p_partkey, n = count(p_size, range:-10..), low = min(p_size, range:-10..)}", "SELECT p_brand, p_size, p_partkey, count(*) OVER w AS n, min(p_size) OVER w AS low FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 10 PRECEDING AND UNBOUNDED FOLLOWING)")
simple("win_variable", "part", "{p_brand; +p_partkey, p_size, n = count(rows:-(p_size % 3)..p_size % 2), s = sum(p_size, rows:-(p_size % 3)..p_size % 2), high = max(p_size, rows:-(p_size % 3)..p_size % 2)}", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) SELECT a.p_brand, a.p_partkey, a.p_size, count(*) AS n, sum(b.p_size)::BIGINT AS s, max(b.p_size) AS high FROM x a JOIN x b ON a.p_brand = b.p_brand AND b.rn BETWEEN a.rn - a.p_size % 3 AND a.rn + a.p_size % 2 GROUP BY ALL")
simple("win_variable_empty", "part", "{p_brand; +p_partkey, p_size, n = count(rows:p_size % 3..1), s = sum(p_size, rows:p_size % 3..1), low = min(p_size, rows:p_size % 3..1)}", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) SELECT a.p_brand, a.p_partkey, a.p_size, count(b.rn) AS n, coalesce(sum(b.p_size), 0)::BIGINT AS s, min(b.p_size) AS low FROM x a LEFT JOIN x b ON a.p_brand = b.p_brand AND b.rn BETWEEN a.rn + a.p_size % 3 AND a.rn + 1 GROUP BY ALL")
simple("win_variable_range", "part", "{p_brand; +p_size, p_partkey, n = count(p_size, range:-(p_partkey % 4L)..2)}", "SELECT a.p_brand, a.p_size, a.p_partkey, count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_size BETWEEN a.p_size - a.p_partkey % 4 AND a.p_size + 2 GROUP BY ALL")
simple("win_variable_groups", "part", "{p_brand; +p_size, p_partkey, n = count(p_size, groups:-(p_partkey % 2L)..1)}", "WITH x AS (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS g FROM part) SELECT a.p_brand, a.p_size, a.p_partkey, count(*) AS n FROM x a JOIN x b ON a.p_brand = b.p_brand AND b.g BETWEEN a.g - a.p_partkey % 2 AND a.g + 1 GROUP BY ALL")
simple("win_plain", "nation", "{n_regionkey; q = 1, n_name}", "SELECT n_regionkey, 1 AS q, n_name FROM nation")
simple("win_arithmetic", "events", "{user_id; +ts, event_id, d = event_id - first(event_id, rows:-1..-1), big = sum(event_id, rows:..0) > 1000000L}", "SELECT user_id, ts, event_id, event_id - coalesce(lag(event_id) OVER w, event_id) AS d, sum(event_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 1000000 AS big FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")

# sets


@query("SELECT n_nationkey::VARCHAR AS k, n_name AS name, n_regionkey AS r FROM nation UNION ALL SELECT r_name, r_name, 0 FROM region")
def concat_auto(t):
    a = t("nation").derive("{k = n_nationkey, name = n_name, r = n_regionkey}")
    return concat(a, t("region").derive("{k = r_name, name = r_name}"))


@query("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
def concat_distinct(t):
    return concat(t("nation").derive("{k = n_regionkey}"), t("region").derive("{k = r_regionkey}")).distinct()


@query("SELECT k, row_number() OVER (ORDER BY k) AS rn FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT 100 + r_regionkey FROM region)")
def concat_ordered(t):
    return _numbered(concat(t("nation").derive("{k = n_nationkey}"), t("region").derive("{k = 100 + r_regionkey}")).sorted("+k").df)


def _views(t):
    a = View(t("customer").df.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("value")))
    return a, View(t("supplier").df.select((F.col("s_suppkey") - 11).alias("key"), F.col("s_nationkey").alias("value")))


_A = "(SELECT c_custkey AS key, c_nationkey AS value FROM customer)"
_B = "(SELECT s_suppkey - 11 AS key, s_nationkey AS value FROM supplier)"


@query(f"SELECT key, CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL THEN a.value + b.value ELSE coalesce(a.value, b.value) END AS value FROM {_A} a FULL JOIN {_B} b USING (key)")
def kv_union(t):
    a, b = _views(t)
    return a.union(b, lambda k, x, y: x + y).df


@query(f"SELECT key, b.value AS value FROM {_A} a JOIN {_B} b USING (key)")
def kv_intersection(t):
    a, b = _views(t)
    return a.intersection(b, kv.second).df


@query(f"SELECT key, value FROM {_A} a WHERE key NOT IN (SELECT key FROM {_B})")
def kv_difference(t):
    a, b = _views(t)
    return a.difference(b).df


@query(f"SELECT key, coalesce(a.value, b.value) AS value FROM {_A} a FULL JOIN {_B} b USING (key) WHERE a.value IS NULL OR b.value IS NULL")
def kv_symmetric(t):
    a, b = _views(t)
    return a.union(b, kv.discard).df


@query(f"SELECT key, value * 2 AS value FROM {_A} WHERE key >= 10 AND key < 90 AND value <> 3")
def kv_bounds(t):
    a, _ = _views(t)
    return a.ge(10).lt(90).filtered(lambda k, v: v != 3).transformed(lambda k, v: v * 2).df


@query("SELECT substring(c_name, 3) AS key, c_custkey AS value FROM customer WHERE starts_with(c_name, 'Cu')")
def kv_prefix(t):
    return View(t("customer").df.select(F.col("c_name").alias("key"), F.col("c_custkey").alias("value"))).prefix("Cu", 2).df


@query(f"SELECT count(*) AS n FROM {_A} WHERE key >= 5 AND key < 50")
def kv_count(t):
    a, _ = _views(t)
    return t("region").df.sparkSession.createDataFrame([(a.count(5, 50),)], "n long")


@query(f"SELECT key FROM {_A}")
def kv_keys(t):
    return _views(t)[0].keys()


@query(f"SELECT * FROM {_A} WHERE key NOT IN (SELECT key FROM {_B}) UNION ALL SELECT * FROM {_B}")
def kv_store(t):
    a, b = _views(t)
    return a.store(b.df).df


@query("SELECT n_nationkey AS key, 'x' || substring(n_name, 2) AS value, length(n_name)::INTEGER AS size FROM nation")
def kv_value_parts(t):
    v = View(t("nation").df.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")))
    return v.write_value(0, "x").df.join(v.value_length().withColumnRenamed("length", "size"), "key")


# changes


def _parts(t):
    return State(Table(t("part").df.select("p_partkey", "p_size", "p_name"), ("p_partkey",), ("p_size", "p_name")))


_NEW = "SELECT p_partkey + 50 AS p_partkey, p_size + 1 AS p_size, 'new' AS p_name FROM part"


def _new(t):
    return t("part").df.select((F.col("p_partkey") + 50).alias("p_partkey"), (F.col("p_size") + 1).alias("p_size"), F.lit("new").alias("p_name"))


@query(f"WITH n AS ({_NEW}) SELECT p_partkey, p_size, p_name FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM n) UNION ALL SELECT * FROM n")
def dml_store(t):
    return _parts(t).store(_new(t)).df


@query(f"WITH n AS ({_NEW}) SELECT p_partkey, p_size, p_name FROM part UNION ALL SELECT * FROM n WHERE p_partkey NOT IN (SELECT p_partkey FROM part)")
def dml_try_insert(t):
    return _parts(t).try_insert(_new(t)).df


@query("SELECT p_partkey, p_size, p_name FROM part UNION ALL SELECT -p_partkey - 1, p_size, p_name FROM part WHERE p_size = 7")
def dml_insert(t):
    rows = t("part").df.where("p_size = 7").select((-F.col("p_partkey") - 1).alias("p_partkey"), "p_size", "p_name")
    return _parts(t).insert(rows).df


@query(f"WITH n AS ({_NEW}) SELECT p.p_partkey, coalesce(n.p_size, p.p_size) AS p_size, coalesce(n.p_name, p.p_name) AS p_name FROM part p LEFT JOIN n USING (p_partkey)")
def dml_replace(t):
    return _parts(t).try_replace(_new(t)).df


@query(f"WITH n AS ({_NEW}) SELECT p.p_partkey, coalesce(n.p_size, p.p_size) AS p_size, p.p_name AS p_name FROM part p LEFT JOIN n USING (p_partkey)")
def dml_update(t):
    return _parts(t).try_update(_new(t).drop("p_name")).df


@query("SELECT p_partkey, 99 AS p_size, p_name FROM part WHERE p_partkey BETWEEN 10 AND 20")
def dml_merge(t):
    rows = t("part").df.where("p_partkey between 10 and 20").select("p_partkey", F.lit(99).alias("p_size"))
    return _parts(t).merge(rows)[1]


@query(f"WITH n AS ({_NEW}) SELECT p_partkey, p_size, p_name FROM part WHERE p_partkey IN (SELECT p_partkey FROM n)")
def dml_exchange(t):
    return _parts(t).exchange(_new(t))[1]


@query(f"WITH n AS ({_NEW}) SELECT p_partkey, p_size, p_name FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM n)")
def dml_delete(t):
    return _parts(t).delete(_new(t).select("p_partkey")).df


@query("SELECT p_partkey, p_size, p_name, (SELECT count(*) FROM part WHERE p_size > 25) AS gone FROM part WHERE NOT p_size > 25")
def dml_delete_all(t):
    state, n = _parts(t).delete_all("p_size > ?", 25)
    return state.df.withColumn("gone", F.lit(n).cast("long"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size * 2 ELSE p_size END AS p_size, p_name FROM part")
def dml_update_scan(t):
    return _parts(t).update_all("p_size > 25", p_size=F.col("p_size") * 2).df


@query("SELECT count(*) AS n, count(*) AS valid FROM part")
def dml_automatic_key(t):
    rows = automatic_key(t("part").df.select("p_size"), "id", 1, 1 << 40)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when((F.col("id") >= 1) & (F.col("id") <= 1 << 40), 1).otherwise(0)).cast("long").alias("valid"))


@query("SELECT count(*) AS n, -count(*) AS low, 2 * count(*) - 2 AS high, count(*) AS apart FROM part")
def dml_automatic_key_dense(t):
    """Keys from so few that all but those of the table are drawn: none twice, none of the table's, no zero."""
    part, n = t("part").df.select("p_partkey"), t("part").df.count()
    rows = automatic_key(part.unionByName(part.selectExpr("-p_partkey as p_partkey").where("p_partkey <> 0")).withColumnRenamed("p_partkey", "other"), "p_partkey", -n, 2 * n - 2, 5, table=part)
    found = rows.agg(F.count_distinct("p_partkey").alias("all"), F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"), F.sum(F.when(F.col("p_partkey") == 0, 1).otherwise(0)).alias("zero"))
    both = rows.join(part, "p_partkey", "left_semi").count()
    return found.select(F.expr(f"`all` - {n - 1} - zero").alias("n"), "low", "high", F.lit(n - both).alias("apart"))


_NAMED = "SELECT min(c_custkey) + 1000000 AS c_custkey, 'n' || (c_custkey % 50) AS c_name FROM customer GROUP BY c_custkey % 50"


def _customers(t, **more):
    return State(Table(t("customer").df.select("c_custkey", "c_name"), ("c_custkey",), ("c_name",)), [("c_name",)], **more)


@query(f"SELECT c_custkey, c_name FROM customer UNION ALL {_NAMED}")
def dml_alternate_key(t):
    """Of rows with one name the first goes in; names that the table has do not."""
    rows = t("customer").df
    new = rows.select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.concat(F.lit("n"), F.col("c_custkey") % 50).alias("c_name"))
    old = rows.select((F.col("c_custkey") + 2_000_000).alias("c_custkey"), "c_name")
    return _customers(t).try_insert(new.unionByName(old)).df


@query("SELECT a.c_custkey, b.c_name FROM customer a JOIN customer b ON b.c_custkey = CASE WHEN a.c_custkey % 2 = 0 AND a.c_custkey < (SELECT max(c_custkey) FROM customer) THEN a.c_custkey + 1 WHEN a.c_custkey % 2 = 1 THEN a.c_custkey - 1 ELSE a.c_custkey END")
def dml_swap_alternate_keys(t):
    """Neighbours swap their names."""
    last = t("customer").df.agg(F.max("c_custkey").alias("last"))
    other = F.when((F.col("c_custkey") % 2 == 0) & (F.col("c_custkey") < F.col("last")), F.col("c_custkey") + 1).when(F.col("c_custkey") % 2 == 1, F.col("c_custkey") - 1).otherwise(F.col("c_custkey"))
    return _customers(t).update(t("customer").df.crossJoin(F.broadcast(last)).select(other.alias("c_custkey"), "c_name")).df


@query("SELECT p_partkey, CASE WHEN p_size > 20 AND p_size < 40 THEN p_size + 10 ELSE p_size END AS p_size, p_name FROM part WHERE NOT p_size >= 45")
def dml_view(t):
    """Through a view: rows outside are neither updated nor deleted."""
    view = State(_parts(t).table, view="p_size > ?", view_args=(20,))
    wider = view.try_update(t("part").df.where("p_size < 40").select("p_partkey", (F.col("p_size") + 10).alias("p_size")))
    gone = t("part").df.where("p_size >= 45").select("p_partkey").unionByName(t("part").df.where("p_size <= 10").select("p_partkey"))
    return wider.delete(gone).df


@query(f"WITH n AS ({_NEW}) SELECT p.p_partkey, n.p_size, p.p_name FROM part p JOIN n USING (p_partkey)")
def dml_try_merge(t):
    return _parts(t).try_merge(_new(t).drop("p_name"))[1]


@query("SELECT CASE WHEN p_size = 7 THEN -p_partkey - 1 ELSE p_partkey END AS id, CASE WHEN p_size = 9 THEN '-1' ELSE p_size::VARCHAR END AS size FROM part WHERE p_size <> 8")
def dml_mapped(t):
    """Changes through a mapped table go back to its source."""
    parts = State(Table(t("part").df.select("p_partkey", "p_size"), ("p_partkey",), ("p_size",)))
    mapped = MappedState(
        parts, lambda df: df.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("size")), {"p_partkey": "id", "p_size": lambda df: F.col("size").cast("int")},
        store="p_partkey < 0", update="p_size >= -1", delete="",
    )
    rows = mapped.df
    moved = mapped.store(rows.where("size = '7'").withColumn("id", -F.col("id") - 1)).delete(rows.where("size in ('7', '8')").select("id"))
    return moved.update(rows.where("size = '9'").select("id", F.lit("-1").alias("size"))).df


@query("SELECT n_nationkey, CASE WHEN r_name = 'ASIA' THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE'")
def dml_update_joined(t):
    """An updater over a join changes and deletes rows of one of its tables."""
    rows = join("n : r", t("nation"), t("region")).derive("{n, r} n.n_regionkey == r.r_regionkey").df
    state = State(Table(t("nation").df.select("n_nationkey", "n_name"), ("n_nationkey",), ("n_name",)))
    asia = rows.where("r.r_name = 'ASIA'").withColumn("n", F.col("n").withField("n_name", F.concat(F.upper("n.n_name"), F.lit("!"))))
    return delete_scanned(rows.where("r.r_name = 'EUROPE'"), **update_scanned(asia, n=state))["n"].df


@query("SELECT 'n' AS side, n_nationkey AS k, n_name || '*' AS v FROM nation UNION ALL SELECT 'r', r_regionkey, r_name || '*' FROM region")
def dml_update_concat(t):
    """An updater over a concatenation changes the tables that hold a key."""
    sides = {"n": Table(t("nation").df.selectExpr("'n' as side", "n_nationkey as k", "n_name as v"), ("side", "k")), "r": Table(t("region").df.selectExpr("'r' as side", "r_regionkey as k", "r_name as v"), ("side", "k"))}
    scan = concat(*sides.values()).df.withColumn("v", F.concat("v", F.lit("*")))
    done = update_scanned(scan, **{n: State(s) for n, s in sides.items()})
    return done["n"].df.unionByName(done["r"].df)


# Python hooks


@query("SELECT l_orderkey, l_linenumber, upper(l_returnflag) || l_linestatus AS code FROM lineitem WHERE l_linenumber <= 2")
def map_udf(t):
    schema = T.StructType([T.StructField("l_orderkey", Y.LONG), T.StructField("l_linenumber", Y.INT), T.StructField("code", Y.STRING)])

    def code(r):
        return {"l_orderkey": r.l_orderkey, "l_linenumber": r.l_linenumber, "code": r.l_returnflag.upper() + r.l_linestatus} if r.l_linenumber <= 2 else None

    return t("lineitem").map(code, schema, source=("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"))


@query("SELECT l_orderkey, l_linenumber, upper(l_returnflag) || l_linestatus AS code FROM lineitem WHERE l_linenumber <= 2")
def map_batches(t):
    schema = T.StructType([T.StructField("l_orderkey", Y.LONG), T.StructField("l_linenumber", Y.INT), T.StructField("code", Y.STRING)])

    def code(b):
        b = b.filter(pc.less_equal(b["l_linenumber"], 2))
        made = pc.binary_join_element_wise(pc.utf8_upper(b["l_returnflag"]), b["l_linestatus"], "")
        return pa.RecordBatch.from_arrays([b["l_orderkey"], b["l_linenumber"], made], names=["l_orderkey", "l_linenumber", "code"])

    return t("lineitem").map(code, schema, source=("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), batches=True)


@query("SELECT user_id, count(*) AS n, max(event_id) - min(event_id) AS spread FROM events GROUP BY 1 HAVING count(*) > 2")
def agg_udf_merged(t):
    schema = T.StructType([T.StructField("user_id", Y.LONG), T.StructField("n", Y.LONG), T.StructField("spread", Y.LONG)])
    return t("events").aggregate(
        ("user_id",), lambda r: (1, r.event_id, r.event_id), lambda s, r: (s[0] + 1, min(s[1], r.event_id), max(s[2], r.event_id)),
        lambda s, k: {"user_id": k[0], "n": s[0], "spread": s[2] - s[1]} if s[0] > 2 else None, schema, ("event_id",),
        merge=lambda a, b: (a[0] + b[0], min(a[1], b[1]), max(a[2], b[2])),
    )


@query("SELECT p_partkey AS k, p_size + 1 AS s FROM part WHERE p_partkey < 40 AND p_size + 1 > 5")
def map_inverse(t):
    schema = T.StructType([T.StructField("k", Y.LONG, False), T.StructField("s", Y.INT, False)])
    return t("part").map(lambda r: {"k": r.p_partkey, "s": r.p_size + 1}, schema, ("p_partkey", "p_size"), {"k": "p_partkey"}).derive("k < 40 && s > 5")


@query("SELECT user_id, count(*) AS n, max(event_id) - min(event_id) AS spread FROM events GROUP BY 1 HAVING count(*) > 2")
def agg_udf(t):
    schema = T.StructType([T.StructField("user_id", Y.LONG), T.StructField("n", Y.LONG), T.StructField("spread", Y.LONG)])
    return t("events").aggregate(
        ("user_id",), lambda r: (1, r.event_id, r.event_id), lambda s, r: (s[0] + 1, min(s[1], r.event_id), max(s[2], r.event_id)),
        lambda s, k: {"user_id": k[0], "n": s[0], "spread": s[2] - s[1]} if s[0] > 2 else None, schema, ("event_id",),
    )


@query("SELECT user_id, event_id, (sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS rolling FROM events")
def group_udf(t):
    schema = T.StructType([T.StructField("user_id", Y.LONG), T.StructField("event_id", Y.LONG), T.StructField("rolling", Y.LONG)])

    def rolling(rows):
        last = []
        for r in rows:
            last = [*last[-2:], r.event_id]
            yield {"user_id": r.user_id, "event_id": r.event_id, "rolling": sum(last)}

    return t("events").group(("user_id",), "+ts", rolling, schema, ("event_id",))


# the catalogue, cursors and single rows


@query("SELECT l_orderkey, l_linenumber, how FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS up, row_number() OVER (ORDER BY l_orderkey DESC, l_linenumber DESC) AS down, 'first' AS how FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) > (300, 3))) WHERE up = 1 UNION ALL SELECT l_orderkey, l_linenumber, how FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey DESC, l_linenumber DESC) AS down, 'lt' AS how FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) < (300, 3))) WHERE down = 1")
def cursor_seek_composite(t):
    lines = Table(t("lineitem").df.select("l_orderkey", "l_linenumber").distinct(), ("l_orderkey", "l_linenumber"))
    key = {"l_orderkey": 300, "l_linenumber": 3}
    return lines.seek("gt", **key).withColumn("how", F.lit("first")).unionByName(lines.seek("lt", **key).withColumn("how", F.lit("lt")))


@query("SELECT count(*) AS n, true AS inside FROM region WHERE r_regionkey = 1")
def cursor_random(t):
    return t("orders").random_row("o_orderkey >= ? && o_orderkey < ?", 100, 900).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.expr("o_orderkey >= 100 and o_orderkey < 900")).alias("inside"))


@query("SELECT count(*) AS n, 0 AS low, 9 AS high, 10 AS kinds, true AS even, true AS unit FROM lineitem")
def expr_random_spread(t):
    """Draws cover all of their range, each value about as often as the others."""
    rows = t("lineitem").derive("{a = random(10), b = random(), c = random(-3, 3)}").df
    shares = rows.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.sum(F.when(F.expr("b >= 0 and b < 1 and c >= -3 and c < 3"), 0).otherwise(1)).alias("out"))
    return shares.agg(F.sum("k").alias("n"), F.min("a").cast("int").alias("low"), F.max("a").cast("int").alias("high"), F.count(F.lit(1)).cast("int").alias("kinds"), (F.max("k") < 2 * F.min("k")).alias("even"), (F.sum("out") == 0).alias("unit"))


@query("SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY o_orderpriority DESC) AS rn FROM orders GROUP BY 1")
def agg_groups_in_order(t):
    return _numbered(t("orders").derive("{-o_orderpriority; n = count()}").df)


@query("SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_regionkey) AS rn FROM region")
def forward_scan(t):
    return _numbered(t.database().open_table("region").scan().select("r_regionkey", "r_name"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 333")
def load_and_try_load(t):
    orders = t.database().open_table("orders")
    row = orders.load(o_orderkey=333)
    assert orders.try_load(o_orderkey=-1) is None
    return t.values("o_orderkey long, o_orderstatus string, o_totalprice double", (row.o_orderkey, row.o_orderstatus, row.o_totalprice))


@query("SELECT n_name AS key, n_nationkey AS value FROM nation WHERE n_name >= 'F' AND n_name < 'R'")
def database_view(t):
    return t.database().as_view(t("nation").df.select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("value"))).ge("F").lt("R").df


@query("SELECT n_nationkey + 1 AS k FROM nation")
def temporary_table(t):
    t.database().temporary("registry_temporary", t("nation").derive("{k = n_nationkey + 1}"))
    return Database(t.spark).open_table("registry_temporary")


@query("SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS name")
def registry_names(t):
    return t.values("name string", *((n,) for n in t.database().names()))


@query("SELECT 'p_partkey' AS name, count(*)::VARCHAR AS n, min(p_partkey)::VARCHAR AS low, max(p_partkey)::VARCHAR AS high FROM part")
def analyze(t):
    found = {r["summary"]: r["p_partkey"] for r in t.database().analyze("part").collect()}
    return t.values("name string, n string, low string, high string", ("p_partkey", found["count"], found["min"], found["max"]))


@query("SELECT n_nationkey AS key, n_name AS value, row_number() OVER (ORDER BY n_nationkey DESC) AS rn FROM nation")
def kv_reverse(t):
    return _numbered(View(t("nation").df.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))).reverse().scan())


@query(f"SELECT a.key, a.value AS old, b.value AS new FROM {_A} a JOIN {_B} b USING (key)")
def kv_exchange(t):
    a, b = _views(t)
    after, before = a.exchange(b.df)
    return before.withColumnRenamed("value", "old").join(after.df.withColumnRenamed("value", "new"), "key")


@query(f"SELECT key, value FROM {_A} a WHERE NOT EXISTS (SELECT 1 FROM {_B} b WHERE b.key = a.key AND b.value = a.value)")
def kv_remove(t):
    a, b = _views(t)
    return a.remove(b.df).df


@query("SELECT n_nationkey AS key, rpad(hex(left(n_name, 1)) || '0000' || hex(substring(n_name, 4, 9)), 24, '0') AS value FROM nation")
def kv_value_resize(t):
    v = View(t("nation").df.select(F.col("n_nationkey").alias("key"), F.encode(F.substring("n_name", 1, 12), "UTF-8").alias("value")))
    return v.clear_value(1, 2).set_value_length(12).df.withColumn("value", F.hex("value"))


@query("SELECT count(*) = 0 AS none, count(*) > 0 AS some FROM region")
def is_empty(t):
    return t.values("none boolean, some boolean", (t("region").is_empty(), not t("region").derive("{*} r_regionkey >= 0").is_empty()))


simple("back_quoted", "nation", "{`n_nationkey`, `odd name` = `n_regionkey` + 1} `n_name` > 'F'", "SELECT n_nationkey, n_regionkey + 1 AS \"odd name\" FROM nation WHERE n_name > 'F'")


@query("SELECT 1 AS n_nationkey, 'box' AS n_name, 3 AS n_regionkey")
def row_boxes(t):
    box = RowBox(t("nation").row_type)
    box["n_nationkey"], box["n_name"], box["n_regionkey"] = 1, "box", 3
    kinds = {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}
    return t.values("n_nationkey int, n_name string, n_regionkey int", tuple(box.get(n, k) for n, k in kinds.items()))


@query("SELECT count(*) AS n, 0 AS columns FROM nation")
def proj_empty(t):
    out = t("nation").derive("{}")
    return t.values("n long, columns int", (out.df.count(), len(out.columns)))


@query("SELECT 'n' AS part, count(*) AS n FROM nation WHERE n_regionkey = 2")
def query_parts(t):
    """A query's row type and number of arguments are known before it runs."""
    from ..lang import parse_query

    text = "{n_nationkey} n_regionkey == ?"
    assert parse_query(text).arguments == 1
    out = t("nation").derive(text, 2)
    assert [f.name for f in out.row_type.fields] == ["n_nationkey"]
    return t.values("part string, n long", ("n", out.df.count()))
