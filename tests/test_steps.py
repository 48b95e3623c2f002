import math

import pytest

from tidemill.lang.errors import ScriptError
from tidemill.lang.parser import parse
from tidemill.plans.runner import Session


@pytest.fixture
def do(spark):
    def run(script, strict=False, **tables):
        s = Session(spark, strict=strict, tables=tables)
        out = s.run(script)
        if s.errors:
            raise ScriptError("run", s.errors[0])
        return [tuple(r) for r in out.collect()], out

    return run


@pytest.fixture
def t(frame):
    return frame([(1, "x", 1.5, True), (2, None, None, False), (None, "y", float("nan"), None), (2, "x", 4.0, True)], "k long, s string, f double, b boolean")


def test_filter_drops_null(do, t):
    assert len(do("v o = t |> filter(k == 2)", t=t)[0]) == 2
    assert len(do("v o = t |> filter(k != 2)", t=t)[0]) == 1
    assert do("v o = t |> filter(b)", t=t)[1].count() == 2
    with pytest.raises(ScriptError, match="needs a condition"):
        do("v o = t |> filter(k)", t=t)


def test_select(do, t):
    assert do("v o = t |> select([s, k])", t=t)[1].columns == ["s", "k"]
    for bad in ("select([k, k])", "select([kk])"):
        with pytest.raises(ScriptError):
            do(f"v o = t |> {bad}", t=t)


def test_aggregates(do, t):
    assert do('v o = t |> sum("f") ', t=t.filter("k = 2"))[0] == [(4.0,)]
    assert do('v o = t |> filter(k > 99) |> sum("k")', t=t)[0] == [(0,)]
    assert do('v o = t |> count("s")', t=t)[0] == [(3,)]
    assert do('v o = t |> max("f")', t=t)[0] == [(4.0,)]
    assert do('v o = t |> min("s")', t=t)[0] == [("x",)]
    got = dict(do('v o = t |> groupBy("k") |> count("s")', t=t)[0])
    assert got == {1: 1, 2: 1, None: 1}
    assert math.isnan(dict(do('v o = t |> groupBy("k") |> max("f")', t=t)[0])[None])
    assert dict(do('v o = t |> groupBy("k") |> variance("f")', t=t)[0])[1] is None
    for bad in ('groupBy("k") |> sum("k")', 'sum("s")', 'groupBy("zz") |> sum("f")'):
        with pytest.raises(ScriptError):
            do(f"v o = t |> {bad}", t=t)


def test_median_interpolates(do, frame):
    assert do('v o = t |> median("a")', t=frame([(1,), (2,), (3,), (4,)], "a int"))[0] == [(2.5,)]


def test_group_is_consumed_once(do, frame):
    d = frame([("a", 1), ("a", 2), ("b", 5)], "g string, x long")
    assert do('v o = t |> groupBy("g") |> sum("x") |> max("x")', t=d)[0] == [(5,)]
    assert sorted(do('v o = t |> groupBy("g") |> count |> filter(x > 1) |> sum("x")', t=d)[0]) == [("a", 2), ("b", 5)]


def test_order_puts_nulls_first(do, t):
    assert do('v o = t |> select([k]) |> orderBy("k", desc: true) |> take(2)', t=t)[0] == [(None,), (2,)]
    assert do('v o = t |> select([k]) |> orderBy("k") |> take(2)', t=t)[0] == [(None,), (1,)]


def test_fill_null_widens(do, t, frame):
    rows, df = do('v o = t |> select([k]) |> fillNull("k", 0.5)', t=t)
    assert df.dtypes == [("k", "double")] and (0.5,) in rows
    assert do('v o = t |> fillNull("a", 7)', t=frame([(None,)], "a int"))[0] == [(7,)]
    assert ("none",) in do('v o = t |> select([s]) |> fillNull("s", "none")', t=t)[0]
    with pytest.raises(ScriptError, match="fillNull"):
        do('v o = t |> fillNull("k", "none")', t=t)


def test_drop_null_keeps_nan(do, t):
    assert do('v o = t |> dropNull("f")', t=t)[1].count() == 3


def test_division(do, frame):
    d = frame([(7, 2, 7.0, 2.0), (-7, 2, 1.0, 0.0), (1, 0, -1.0, 0.0), (1, None, 0.0, 0.0), (1, 1, None, 0.0), (1, 1, float("nan"), 0.0)], "a int, b int, x double, y double")
    rows = do('v o = t |> withColumn("q", a / b) |> withColumn("r", x / y) |> select([q, r])', t=d)[0]
    assert [r[0] for r in rows] == [3, -3, None, None, 1, 1]
    assert rows[0][1] == 3.5 and rows[1][1] == math.inf and rows[2][1] == -math.inf and math.isnan(rows[3][1]) and rows[4][1] is None and math.isnan(rows[5][1])


def test_arithmetic_types(do, frame):
    d = frame([(9223372036854775807, "a", 1)], "a long, s string, i int")
    assert do('v o = t |> withColumn("z", a + 1) |> select([z])', t=d)[0] == [(None,)]
    assert do('v o = t |> withColumn("z", s + "b") |> select([z])', t=d)[0] == [("ab",)]
    for bad in ("s + 1", "s > 1", "s - s", "s == true"):
        with pytest.raises(ScriptError):
            do(f'v o = t |> withColumn("z", {bad})', t=d)


def test_cast(do, frame):
    d = frame([("1", "true", 45.9), ("x", "maybe", -45.9)], "a string, b string, f double")
    assert do('v o = t |> cast("a", "int") |> cast("b", "bool") |> cast("f", "int")', t=d)[0] == [(1, True, 45), (None, None, -45)]
    with pytest.raises(ScriptError):
        do('v o = t |> cast("a", "string")', t=d)


def test_rename_and_replace(do, frame):
    d = frame([("a.b.c", 1)], "`x.y` string, n int")
    assert do('v o = t |> rename("nope", "z") |> replace("x.y", ".", "")', t=d)[0] == [("abc", 1)]
    assert do('v o = t |> rename("n", "m")', t=d)[1].columns == ["x.y", "m"]
    for bad in ('replace("n", "1", "2")', 'rename("n", "x.y")'):
        with pytest.raises(ScriptError):
            do(f"v o = t |> {bad}", t=d)


def test_joins(do, frame):
    a = frame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    b = frame([(1, "p"), (3, "q"), (None, "r")], "k int, x string")
    rows, df = do('v o = a |> join(b, on: "k")', a=a, b=b)
    assert df.columns == ["k", "x", "x_right"] and rows == [(1, "a", "p")]
    assert len(do('v o = a |> join(b, on: "k", how: "left")', a=a, b=b)[0]) == 3
    rows, df = do('v o = a |> join(b, on: "k", how: "outer")', a=a, b=b)
    assert df.columns == ["k", "x", "k_right", "x_right"] and len(rows) == 5
    assert len(do('v o = a |> join(b, how: "cross")', a=a, b=b)[0]) == 9
    assert len(do('v o = a |> join(a, on: "k")', a=a)[0]) == 2
    for bad in ('join(b, on: "zz")', "join(b)", 'join(b, on: "k", how: "cross")', 'join(c, on: "k")'):
        with pytest.raises(ScriptError):
            do(f"v o = a |> {bad}", a=a, b=b)


def test_sample_depends_on_rows_only(do, spark):
    d = spark.range(1000)
    one = sorted(do("v o = t |> sample(10, seed: 4)", t=d.repartition(2))[0])
    assert one == sorted(do("v o = t |> sample(10, seed: 4)", t=d.repartition(7))[0]) and len(one) == 10
    assert one != sorted(do("v o = t |> sample(10, seed: 5)", t=d)[0])
    assert len(do("v o = t |> sample(5000, seed: 4)", t=d)[0]) == 1000
    with pytest.raises(ScriptError):
        do("v o = t |> sample(5000, seed: 4)", strict=True, t=d)


def test_unseeded_sample_is_the_same_for_all_readers(do, spark):
    rows, _ = do('v s = t |> sample(20)\nv n = s |> rename("id", "id2")\nv o = s |> join(n, left_on: "id", right_on: "id2")', t=spark.range(5000))
    assert len(rows) == 20


def test_failed_statement_is_isolated(spark, t):
    s = Session(spark, tables={"t": t})
    out = s.run("v a = t |> take(1)\nv b = nowhere |> take(1)\nv c = t |> select([zz])")
    assert out.count() == 1 and s.last == "a" and len(s.errors) == 2 and "did you mean" not in s.errors[0]


def test_models_and_charts_leave_messages(spark, t, tmp_path):
    s = Session(spark, tables={"t": t}, chart_folder=str(tmp_path))
    s.run('model M { Dense(3) -> ReLU() }\nrun t |> train(M, target: "f")\nt |> dropNull("k") |> chart { type: bar x: k y: f title: "</script><b>" }')
    assert [m.split("]")[0] for m in s.messages] == ["[tidemill:model", "[tidemill:train", "[tidemill:chart"]
    assert s.charts[0]["chartType"] == "bar" and len(s.charts[0]["data"]) == 3
    page = (tmp_path / "t_chart.html").read_text()
    assert "</script><b>" not in page and "http://www.w3.org" in page


def test_plans_reach_the_scan(spark):
    from tidemill.plans.catalog import CATALOG

    df = CATALOG["flagship_top_suppliers"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,20.0)]" in plan and "TakeOrderedAndProject" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_extendedprice:double>" in plan


def test_parse_is_shared_with_the_fluent_api(spark):
    from tidemill.api import table

    path = "/root/testdata/sf0.001/orders.parquet"
    a = table("Orders", path).filter("o_totalprice > 1000.0").group_by("o_orderstatus").count("o_orderkey").order_by("o_orderkey")
    s = Session(spark)
    b = s.run(f'v o = load("{path}") :: Orders |> filter(o_totalprice > 1000.0) |> groupBy("o_orderstatus") |> count("o_orderkey") |> orderBy("o_orderkey")')
    assert a.dataframe(spark).collect() == b.collect()
    n = table("Nation", "/root/testdata/sf0.001/nation.parquet")
    r = table("Region", "/root/testdata/sf0.001/region.parquet")
    assert n.join(r, left_on="n_regionkey", right_on="r_regionkey").dataframe(spark).count() == 25
    assert parse("v a = b").statements[0].ops == ()
