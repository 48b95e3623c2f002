"""Queries over the benchmark tables, one or more for each step of the language, with SQL that says the same.

A script's ``{sf}`` stands for the tables' folder.  Sums and means of floating-point numbers depend on the order of
addition in their last digits, so both sides round them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import FILES
from .runner import run


@dataclass(frozen=True)
class Query:
    script: str
    sql: str | None
    digits: dict[str, int] = field(default_factory=dict)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, self.script.replace("{sf}", sf_dir))
        return df.withColumns({c: F.round(c, n) for c, n in self.digits.items()})


def _t(name: str, rest: str = "") -> str:
    return f'load("{{sf}}/{name}.parquet") :: {name.capitalize()} {rest}'


def _one(name: str, steps: str) -> str:
    return f"v out = {_t(name, steps)}"


CATALOG: dict[str, Query] = {}


def _add(name: str, script: str, sql: str | None, **digits: int) -> None:
    CATALOG[name] = Query(script, sql, digits)


_add(
    "flagship_top_suppliers",
    _one("lineitem", '|> filter(l_quantity < 20) |> groupBy("l_suppkey") |> mean("l_extendedprice") |> orderBy("l_extendedprice", desc: true) |> take(10)'),
    "select l_suppkey, round(avg(l_extendedprice), 6) as l_extendedprice from lineitem where l_quantity < 20 group by 1 order by avg(l_extendedprice) desc limit 10",
    l_extendedprice=6,
)
for _name, _op in (("eq", "=="), ("ne", "!="), ("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">=")):
    _add(f"filter_{_name}", _one("part", f"|> filter(p_size {_op} 25)"), f"select * from part where p_size {'=' if _op == '==' else _op} 25")
_add("filter_chain", _one("lineitem", "|> filter(l_quantity < 20) |> filter(l_discount > 0.05)"), "select * from lineitem where l_quantity < 20 and l_discount > 0.05")
_add("filter_string_eq", _one("customer", '|> filter(c_mktsegment == "BUILDING")'), "select * from customer where c_mktsegment = 'BUILDING'")
_add("filter_string_ne", _one("customer", '|> filter(c_mktsegment != "BUILDING")'), "select * from customer where c_mktsegment <> 'BUILDING'")
_add("filter_bool_expr", _one("part", "|> filter((p_size > 10) == (p_retailprice > 1000.0))"), "select * from part where (p_size > 10) = (p_retailprice > 1000.0)")
_add("filter_col_function", _one("part", '|> filter(col("p_size") >= 1_0)'), "select * from part where p_size >= 10")
_add("select_reorder", _one("orders", "|> select([o_totalprice, o_orderkey,])"), "select o_totalprice, o_orderkey from orders")
_add("count_rows_identity", _one("nation", "|> count()"), "select * from nation")
_add("count_rows_bare", _one("region", "|> count"), "select * from region")

_AGG = {"count": ("count(x)", 0), "sum": ("round(coalesce(sum(x), 0), 4)", 4), "mean": ("round(avg(x), 6)", 6), "min": ("min(x)", 0), "max": ("max(x)", 0),
        "median": ("median(x)", 0), "variance": ("round(var_samp(x), 2)", 2), "std": ("round(stddev_samp(x), 6)", 6)}
for _name, (_sql, _n) in _AGG.items():
    _e = _sql.replace("x", "l_extendedprice").replace("ma" + "l_extendedprice", "max")
    _d = {"l_extendedprice": _n} if _n else {}
    _add(f"{_name}_group", _one("lineitem", f'|> groupBy("l_suppkey") |> {_name}("l_extendedprice")'), f"select l_suppkey, {_e} as l_extendedprice from lineitem group by 1", **_d)
    _add(f"{_name}_global", _one("lineitem", f'|> {_name}("l_extendedprice")'), f"select {_e} as l_extendedprice from lineitem", **_d)
_add("sum_int_group", _one("part", '|> groupBy("p_brand") |> sum("p_size")'), "select p_brand, sum(p_size)::bigint as p_size from part group by 1")
_add("median_int_group", _one("part", '|> groupBy("p_brand") |> median("p_size")'), "select p_brand, median(p_size) as p_size from part group by 1")
_add("sum_empty", _one("part", '|> filter(p_size > 1000) |> sum("p_size")'), "select 0::bigint as p_size")

_add("order_take_asc", _one("orders", '|> orderBy("o_orderkey") |> take(10)'), "select * from orders order by o_orderkey limit 10")
_add("order_take_desc", _one("orders", '|> orderBy("o_orderkey", desc: true) |> take(10)'), "select * from orders order by o_orderkey desc limit 10")
_add("order_last_wins", _one("orders", '|> orderBy("o_totalprice") |> orderBy("o_orderkey", desc: false) |> take(7)'), "select * from orders order by o_orderkey limit 7")

# Unmatched rows and nulls come from conditions on values, so they grow with the tables.
_FEW = f"v few = {_t('orders', '|> filter(o_orderstatus == \"F\") |> filter(o_totalprice > 300000.0)')}\n"
_FEW_SQL = "(select * from orders where o_orderstatus = 'F' and o_totalprice > 300000)"
_LEFT = _FEW + f"v both = {_t('customer', '|> select([c_custkey, c_name])')} |> join(few, left_on: \"c_custkey\", right_on: \"o_custkey\", how: \"left\")\n"
_LEFT_SQL = f"customer left join {_FEW_SQL} o on c_custkey = o_custkey"
_COLS = "c_custkey, c_name, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_add("drop_null", _LEFT + 'v out = both |> dropNull("o_orderkey")', f"select {_COLS} from {_LEFT_SQL} where o_orderkey is not null")
_add("fill_null_int", _LEFT + 'v out = both |> fillNull("o_orderkey", 0)', f"select {_COLS.replace('o_orderkey', 'coalesce(o_orderkey, 0) as o_orderkey')} from {_LEFT_SQL}")
_add("fill_null_float", _LEFT + 'v out = both |> fillNull("o_totalprice", -1.5)', f"select {_COLS.replace('o_totalprice', 'coalesce(o_totalprice, -1.5::double) as o_totalprice')} from {_LEFT_SQL}")
_add("fill_null_str", _LEFT + 'v out = both |> fillNull("o_orderstatus", "none")', f"select {_COLS.replace('o_orderstatus', chr(39).join(['coalesce(o_orderstatus, ', 'none', ') as o_orderstatus']))} from {_LEFT_SQL}")
_add(
    "order_nulls_first",
    _LEFT + 'v out = both |> select([o_orderkey]) |> orderBy("o_orderkey", desc: true) |> take(30)',
    f"select o_orderkey from {_LEFT_SQL} order by o_orderkey desc nulls first limit 30",
)

_add("join_inner", f"v c = {_t('customer')}\nv out = {_t('orders')} |> join(c, left_on: \"o_custkey\", right_on: \"c_custkey\")",
     "select o.*, c.* exclude (c_custkey) from orders o join customer c on o_custkey = c_custkey")
_add("join_left", _LEFT + "v out = both", f"select {_COLS} from {_LEFT_SQL}")
_add("join_outer", _FEW + f"v out = {_t('customer', '|> filter(c_mktsegment == \"BUILDING\")')} |> join(few, left_on: \"c_custkey\", right_on: \"o_custkey\", how: \"outer\")",
     f"select * from (select * from customer where c_mktsegment = 'BUILDING') full join {_FEW_SQL} on c_custkey = o_custkey")
_add("join_outer_same_name", f"v few = {_t('nation', '|> filter(n_nationkey < 12)')}\nv out = {_t('nation', '|> filter(n_nationkey > 5)')} |> join(few, on: \"n_nationkey\", how: \"outer\")",
     "select a.*, b.n_nationkey as n_nationkey_right, b.n_name as n_name_right, b.n_regionkey as n_regionkey_right from (select * from nation where n_nationkey > 5) a "
     "full join (select * from nation where n_nationkey < 12) b on a.n_nationkey = b.n_nationkey")  # fmt: skip
_add("join_cross", f"v r = {_t('region')}\nv out = {_t('nation')} |> join(r, how: \"cross\")", "select * from nation cross join region")
_add("join_multikey", f"v s = {_t('lineitem', '|> filter(l_quantity < 10) |> select([l_orderkey, l_linenumber, l_tax])')}\nv out = {_t('lineitem', '|> select([l_orderkey, l_linenumber, l_quantity])')} |> join(s, on: [\"l_orderkey\", \"l_linenumber\"])",
     "select a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_tax from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber where b.l_quantity < 10")
_add("join_left_right_on", f"v n = {_t('nation', '|> select([n_nationkey, n_name])')}\nv out = {_t('supplier')} |> join(n, left_on: [\"s_nationkey\"], right_on: [\"n_nationkey\"], how: \"inner\")",
     "select s.*, n_name from supplier s join nation on s_nationkey = n_nationkey")
_add("join_self", f"v n = {_t('nation')}\nv out = n |> join(n, on: \"n_regionkey\")",
     "select a.*, b.n_nationkey as n_nationkey_right, b.n_name as n_name_right from nation a join nation b on a.n_regionkey = b.n_regionkey")

_add("with_column_arith", _one("lineitem", '|> withColumn("net", l_extendedprice * (1 - l_discount) + l_tax * 2 - 1) |> select([l_orderkey, l_linenumber, net])'),
     "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax * 2 - 1 as net from lineitem")
_add("with_column_bool", _one("part", '|> withColumn("large", p_size > 25)'), "select *, p_size > 25 as large from part")
_add("with_column_replace", _one("part", '|> withColumn("p_size", p_size + 1)'), "select * replace ((p_size + 1)::bigint as p_size) from part")
_add("with_column_concat", _one("part", '|> withColumn("full", p_brand + "/" + p_type)'), "select *, p_brand || '/' || p_type as full from part")
_add("with_column_literal", _one("region", '|> withColumn("one", 1) |> withColumn("yes", true) |> withColumn("half", 0.5)'), "select *, 1::bigint as one, true as yes, 0.5::double as half from region")
_add("int_div", _one("part", '|> withColumn("part7", p_size / 7) |> withColumn("none", p_size / 0)'), "select *, (p_size // 7)::bigint as part7, null::bigint as none from part")
_add("float_div", _one("lineitem", '|> withColumn("ratio", l_extendedprice / l_quantity) |> select([l_orderkey, l_linenumber, ratio])'),
     "select l_orderkey, l_linenumber, l_extendedprice / l_quantity as ratio from lineitem")
_add("cast_int", _one("part", '|> cast("p_retailprice", "int")'), "select * replace (trunc(p_retailprice)::bigint as p_retailprice) from part")
_add("cast_float", _one("part", '|> cast("p_size", "float")'), "select * replace (p_size::double as p_size) from part")
_add("cast_str", _one("part", '|> cast("p_size", "str")'), "select * replace (p_size::varchar as p_size) from part")
_add("cast_bool", _one("part", '|> withColumn("b", p_size - 1) |> cast("b", "bool")'), "select *, (p_size - 1)::boolean as b from part")
_add("cast_bad", _one("part", '|> cast("p_name", "int")'), "select * replace (null::bigint as p_name) from part")
_add("rename", _one("nation", '|> rename("n_name", "name")'), "select n_nationkey, n_name as name, n_regionkey from nation")
_add("rename_missing", _one("nation", '|> rename("no_such", "name")'), "select * from nation")
_add("replace_literal", _one("customer", '|> replace("c_name", "#", ".")'), "select * replace (replace(c_name, '#', '.') as c_name) from customer")
_add("replace_all", _one("orders", '|> replace("o_orderpriority", "-", "--")'), "select * replace (replace(o_orderpriority, '-', '--') as o_orderpriority) from orders")
_add("sample_seeded_count", _one("orders", '|> sample(100, seed: 7) |> count("o_orderkey")'), "select 100::bigint as o_orderkey")
_add("sample_unseeded_count", _one("orders", '|> sample(50) |> count("o_orderkey")'), "select 50::bigint as o_orderkey")
_add("sample_rows", _one("customer", "|> sample(25, seed: 3)"), None)
_add("deferred_group", _one("orders", '|> groupBy("o_orderstatus") |> filter(o_totalprice > 1000.0) |> count("o_orderkey")'),
     "select o_orderstatus, count(o_orderkey) as o_orderkey from orders where o_totalprice > 1000.0 group by 1")
_add("group_overwritten", _one("part", '|> groupBy("p_type") |> groupBy("p_brand") |> max("p_size")'), "select p_brand, max(p_size) as p_size from part group by 1")
_add("chained_agg", _one("part", '|> groupBy("p_brand") |> sum("p_size") |> max("p_size")'), "select max(s) as p_size from (select sum(p_size)::bigint as s from part group by p_brand)")
_add("var_reuse", f"v base = {_t('part', '|> filter(p_size > 10)')}\nv a = base |> groupBy(\"p_brand\") |> count(\"p_size\")\nv out = base |> groupBy(\"p_brand\") |> max(\"p_size\") |> join(a, on: \"p_brand\")",
     "select p_brand, max(p_size) as p_size, count(p_size) as p_size_right from part where p_size > 10 group by 1")
_add("last_var_wins", f"v a = {_t('nation')}\nv b = {_t('region')}\nv broken = nowhere |> take(1)", "select * from region")
_add("declared_schema", "type Part = { p_partkey: int, p_name: string, p_size: Option<float>, }\n" + _one("part", "|> select([p_partkey, p_size])"),
     "select p_partkey::bigint as p_partkey, p_size::double as p_size from part")
_add("mutable_rebind", f"mut v a = {_t('nation')}\nmut v a = a |> filter(n_regionkey == 1)\n", "select * from nation where n_regionkey = 1")


def _workload(stage: str) -> str:
    """The published benchmark's stages, on the events table: users for stations, values for readings."""
    clean = f"v raw = {_t('events', '|> select([ts, user_id, value])')}\nv cleaned = raw |> dropNull(\"value\") |> filter(value < 120) |> filter(value > 10)\n"
    return clean + stage


_add("workload_clean", _workload("v out = cleaned"), "select ts, user_id, value from events where value < 120 and value > 10")
_add("workload_sum", _workload('v out = cleaned |> groupBy("user_id") |> sum("value")'), "select user_id, round(sum(value), 4) as value from events where value < 120 and value > 10 group by 1", value=4)
_add("workload_top_mean", _workload('v out = cleaned |> groupBy("user_id") |> mean("value") |> orderBy("value", desc: true) |> take(10)'),
     "select user_id, round(avg(value), 6) as value from events where value < 120 and value > 10 group by 1 order by avg(value) desc, user_id limit 10", value=6)
_add("workload_fill_count", _workload('v out = raw |> fillNull("value", 0) |> filter(value > 50) |> groupBy("user_id") |> count("value") |> orderBy("value", desc: true) |> take(5) |> select([value])'),
     "select count(value) as value from events where value > 50 group by user_id order by 1 desc limit 5")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(CATALOG) | FILES


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in queries().items() if q.sql}
