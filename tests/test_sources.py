import json

import pytest

from tidemill import project
from tidemill.lang.errors import ScriptError
from tidemill.plans.check import check
from tidemill.plans.runner import Session
from tidemill.plans.translate import describe, emit_pyspark
from tidemill.sources import infer, sinks

ROWS = "2026-01-01,Mapo,10.5,1\n2026-01-02,Jongno,-,\n2026-01-03,점검중,N/A, \n2026-01-04,Mapo,abc,4\n"
DECL = "type Air = { date: string, station: string, pm10: Option<float>, pm25: Option<int> }\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "u.csv").write_text("일시,구분,미세먼지(PM10),초미세먼지\n" + ROWS, encoding="utf-8")
    (tmp_path / "k.csv").write_bytes(("일시,구분,미세먼지(PM10),초미세먼지\n" + ROWS).encode("cp949"))
    (tmp_path / "wide.csv").write_text("a,b,c,d,extra\n1,2,3,4,5\n", encoding="utf-8")
    (tmp_path / "narrow.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfa,b\n007,x\n")
    return tmp_path


@pytest.mark.parametrize("name", ["u.csv", "k.csv"])
def test_declared_csv(spark, files, name):
    df = Session(spark).run(DECL + f'v a = load("{files}/{name}") :: Air')
    assert df.dtypes == [("date", "string"), ("station", "string"), ("pm10", "double"), ("pm25", "bigint")]
    assert [tuple(r) for r in df.orderBy("date").collect()] == [
        ("2026-01-01", "Mapo", 10.5, 1), ("2026-01-02", "Jongno", None, None), ("2026-01-03", None, None, None), ("2026-01-04", "Mapo", None, 4),
    ]


def test_violations_and_strict(spark, files):
    s = Session(spark)
    s.run(DECL + f'v a = load("{files}/u.csv") :: Air')
    assert s.violations("a") == {"station": 1}
    strict = Session(spark, strict=True)
    assert strict.run(DECL + f'v a = load("{files}/u.csv") :: Air') is None and "station" in strict.errors[0]


def test_undeclared_and_surplus_columns(spark, files):
    df = Session(spark).run(f'v a = load("{files}/bom.csv") :: Nothing')
    assert df.dtypes == [("a", "bigint"), ("b", "string")]
    df = Session(spark).run(DECL + f'v a = load("{files}/wide.csv") :: Air')
    assert df.columns == ["date", "station", "pm10", "pm25", "extra"] and df.schema["extra"].dataType.simpleString() == "bigint"
    s = Session(spark)
    assert s.run(DECL + f'v a = load("{files}/narrow.csv") :: Air') is None and "pm10" in s.errors[0]


def test_csv_sink_and_result(spark, files, tmp_path):
    df = Session(spark).run(DECL + f'v a = load("{files}/u.csv") :: Air |> filter(pm25 == 1)')
    sinks.write_csv(df, str(tmp_path / "out"), single=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).collect()[0]["station"] == "Mapo"
    got = sinks.result(df)
    assert got["rows"] == [{"date": "2026-01-01", "pm10": 10.5, "pm25": 1, "station": "Mapo"}]
    assert [x["type"] for x in got["schema"]] == ["str", "str", "float", "int"]
    assert sinks.cell(float("inf")) is None and json.loads(sinks.marker("x", {"a": 1}).split("] ")[1]) == {"a": 1}


def test_inference():
    assert [infer.cell_type(x) for x in (" TRUE ", "7", "-7.5", "1e3", "x", "99999999999999999999")] == ["bool", "int", "float", "float", "string", "float"]
    assert [infer.merged(x) for x in (["int", "float"], ["bool", "int"], ["int"], ["string", "int"])] == ["float", "string", "int", "string"]
    fields = infer.field_types(["a", "b", "c", "d"], [["1", "", "", "true"], ["2.5", "x", "", "1"]])
    assert fields == [("a", "float"), ("b", "Option<string>"), ("c", "string"), ("d", "string")]
    assert infer.type_name("d/seoul_air-2026.csv") == "SeoulAir2026"
    assert [infer.variable_name(x) for x in ("seoul_air.csv", "air_2026.csv", "population.csv", "a_b.csv")] == ["air", "air", "population", "a"]
    assert "pm10: Option<float>" in infer.declaration("x_air.csv", "pm10,k\n1.5,1\n,2\n".encode())


def test_check(spark):
    script = DECL + 'v a = load("nowhere.csv") :: Air |> select([station, pm10])\nv b = a |> groupBy("station") |> sum("pm1")\nv c = a |> withColumn("z", pm10 / 0)\nv d = q |> take(1)'
    found = check(spark, script)
    assert [(f.level, f.where) for f in found] == [("error", "b"), ("warning", "c"), ("error", "d")]
    assert "did you mean 'pm10'" in found[0].message
    assert check(spark, "v = ")[0].level == "error"
    assert check(spark, 'v a = load("x") :: Unknown |> filter(zz > 1)')[0].level == "warning"


def test_translation(spark, files):
    script = DECL + f'v a = load("{files}/u.csv") :: Air |> filter(pm25 > 1) |> groupBy("station") |> max("pm25")\nv b = a |> take(5)'
    assert "filter where=(pm25 > 1)" in describe(script)
    code = emit_pyspark(script).replace("b.show(5)", "")
    scope: dict = {}
    exec(compile(code, "emitted", "exec"), scope)
    assert [tuple(r) for r in scope["b"].collect()] == [tuple(r) for r in Session(spark).run(script).collect()]


def test_project(tmp_path, monkeypatch):
    root = project.new(str(tmp_path / "p"))
    monkeypatch.chdir(root)
    block = project.import_csv("data/sample.csv")
    assert block.startswith("type Sample = {\n  station: string,\n  pm10: float,") and project.import_csv("data/sample.csv") == ""
    assert project.verified("x", project.fingerprint("x")) and not project.verified("y", project.fingerprint("x"))


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from tidemill import cli

    monkeypatch.setattr(cli, "_spark", lambda: spark)
    root = project.new(str(tmp_path / "p"))
    monkeypatch.chdir(root)
    assert cli.main(["run", "example.mill", "--output", str(tmp_path / "out")]) == 0
    got = capsys.readouterr().out
    assert '[tidemill:result] {"rows": [{"date": "2025-06-0' in got
    assert cli.main(["check", "example.mill"]) == 0 and cli.main(["emit", "pyspark", "example.mill"]) == 0 and cli.main(["plan", "example.mill"]) == 0 and cli.main(["hash", "example.mill"]) == 0
    assert cli.main(["run", "nowhere.mill"]) == 1


def test_service(spark, tmp_path):
    from tidemill.server import inside, respond

    root = project.new(str(tmp_path / "p"))

    def post(path, **body):
        return respond(spark, root, "POST", path, "application/json", json.dumps(body).encode())

    assert respond(spark, root, "GET", "/health", "", b"")[1]["status"] == "ok"
    ok = post("/execute", code=project.EXAMPLE)[1]
    assert ok["success"] and len(ok["rows"]) == 5
    assert post("/execute", code="v = 1")[1]["success"] is False
    assert "outside" in post("/execute", code='v a = load("../../etc/passwd") :: X')[1]["logs"][0]
    h = post("/security/audit", code="x")[1]["hash"]
    assert post("/security/verify", code="x", hash=h)[1] == {"valid": True}
    form = b'--b\r\nContent-Disposition: form-data; name="file"; filename="a_b.csv"\r\n\r\nx,y\n1,\n2,z\n\r\n--b--\r\n'
    assert respond(spark, root, "POST", "/schema", "multipart/form-data; boundary=b", form)[1]["fields"] == [{"name": "x", "type": "int"}, {"name": "y", "type": "string"}]
    assert post("/nowhere")[0] == 404 and respond(spark, root, "POST", "/execute", "", b"{")[0] == 400
    with pytest.raises(ScriptError):
        inside(root)("file:///etc/passwd")


def test_streams(spark, tmp_path):
    from tidemill.lang.parser import parse
    from tidemill.streaming.files import append_to, follow

    spark.range(10).write.parquet(str(tmp_path / "in"))
    ops = parse('v a = b |> filter(id > 6) |> withColumn("x", id * 2)').statements[0].ops
    df = follow(spark, str(tmp_path / "in"), spark.range(1).schema, ops)
    append_to(df, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [14, 16, 18]
    with pytest.raises(ScriptError):
        follow(spark, str(tmp_path / "in"), spark.range(1).schema, parse('v a = b |> orderBy("id")').statements[0].ops)


def test_a_chart_holds_every_row_or_is_refused(spark, monkeypatch):
    args = {"kind": "bar", "x": "id", "y": "id"}
    assert len(sinks.chart_spec(spark.range(12_000), args)["data"]) == 12_000
    monkeypatch.setattr(sinks, "CHART_ROWS", 3)
    assert len(sinks.chart_spec(spark.range(3), args)["data"]) == 3
    with pytest.raises(ScriptError, match="VIZ004"):
        sinks.chart_spec(spark.range(8), args)


def test_quoted_line_breaks_are_part_of_a_cell(spark, tmp_path):
    text = 'a,b\n1,"x\ny, ""z"""\n2,plain\n'
    (tmp_path / "q.csv").write_text(text, encoding="utf-8")
    want = [(1, 'x\ny, "z"'), (2, "plain")]
    assert sorted(map(tuple, Session(spark).run(f'v a = load("{tmp_path}/q.csv") :: Nothing').collect())) == want
    (tmp_path / "k.csv").write_bytes(text.replace("plain", "한글").encode("cp949"))
    got = sorted(map(tuple, Session(spark).run(f'v a = load("{tmp_path}/k.csv") :: Nothing').collect()))
    assert got == [want[0], (2, "한글")]
    # One folder with files of each kind.
    (tmp_path / "d").mkdir()
    for name, raw in (("1 a 100%.csv", text.encode()), ("둘 2.csv", text.replace("plain", "한글").encode("cp949")), ("3.csv", "a,b\n3,é\n".encode())):
        (tmp_path / "d" / name).write_bytes(raw)
    before = dict(spark.conf.getAll)
    got = sorted(map(tuple, Session(spark).run(f'v a = load("{tmp_path}/d") :: Nothing').collect()))
    assert got == [want[0], want[0], want[1], (2, "한글"), (3, "é")] and dict(spark.conf.getAll) == before
    assert Session(spark, encoding="utf-8", multiline=False).run(f'v a = load("{tmp_path}/q.csv") :: Nothing').count() == 3  # as told


def test_types_follow_every_cell(spark, tmp_path):
    (tmp_path / "late.csv").write_text("n,f,b,t,e\n" + "1,1,true,1,\n" * 250 + "2,1.5,FALSE,foo,\n", encoding="utf-8")
    df = Session(spark).run(f'v a = load("{tmp_path}/late.csv") :: Nothing')
    assert [k for _, k in df.dtypes] == ["bigint", "double", "boolean", "string", "string"]
    assert df.filter("t = 'foo' and f = 1.5 and n = 2 and not b").count() == 1 and df.filter("n is null or f is null or b is null or t is null").count() == 0
    (tmp_path / "big.csv").write_text("x\n1\n99999999999999999999\n", encoding="utf-8")
    assert Session(spark).run(f'v a = load("{tmp_path}/big.csv") :: Nothing').dtypes == [("x", "double")]


def test_results_leave_nothing_on_the_cluster(spark):
    from tidemill.plans.catalog import CATALOG

    for name in ("sample_unseeded_count", "var_reuse"):
        CATALOG[name](spark, "/root/testdata/sf0.001").collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
