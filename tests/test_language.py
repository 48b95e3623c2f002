import pytest

from tidemill.lang import tree as T
from tidemill.lang.errors import ScriptError
from tidemill.lang.lexer import tokenize
from tidemill.lang.parser import STEPS, parse, parse_expression


def kinds(text):
    return [(t.kind, t.value) for t in tokenize(text)[:-1]]


def test_tokens():
    assert kinds('v x = 1_000 |> "a\\n\\"b" // note\n-> ::') == [
        ("keyword", "v"), ("word", "x"), ("symbol", "="), ("int", 1000), ("symbol", "|>"), ("string", 'a\n"b'), ("symbol", "->"), ("symbol", "::"),
    ]
    assert kinds("미세 1.5 -2") == [("word", "미세"), ("float", 1.5), ("int", -2)]
    assert kinds("a - 1") == [("word", "a"), ("symbol", "-"), ("int", 1)]


def test_places_of_tokens():
    t = tokenize("v a\n  = b")
    assert [(x.line, x.col) for x in t[:4]] == [(1, 1), (1, 3), (2, 3), (2, 5)]


@pytest.mark.parametrize("bad", ['"open', "a & b", "a ! b", "99999999999999999999"])
def test_lexer_refuses(bad):
    with pytest.raises(ScriptError) as e:
        tokenize(bad)
    assert e.value.category == "lex"


def test_type_declaration():
    p = parse("type A = { a: int, b: Option<float>, }; type B = { c: string }")
    assert p.statements == [T.TypeDecl("A", (("a", "int"), ("b", "Option<float>"))), T.TypeDecl("B", (("c", "string"),))]


def test_pipeline_statement():
    s = parse('v x = load("f.csv") :: A |> dropNull("a") |> take(3);').statements[0]
    assert s.source == T.Load("f.csv", "A") and [op.name for op in s.ops] == ["dropNull", "take"]
    assert parse("mut v y = x").statements[0] == T.Assign("y", T.Ref("x"), (), True)


def test_expression_statement_and_last_token():
    assert parse("x |> count").statements[0].source == T.Ref("x")
    with pytest.raises(ScriptError):
        parse("x")


def test_precedence_and_parentheses():
    assert parse_expression("a + b * 2 > 1") == T.Binary(">", T.Binary("+", T.Col("a"), T.Binary("*", T.Col("b"), T.Lit(2))), T.Lit(1))
    assert parse_expression("(a > 1) == (b > 2)").op == "=="
    assert parse_expression('col("count") / 2') == T.Binary("/", T.Col("count"), T.Lit(2))
    with pytest.raises(ScriptError):
        parse_expression("a < b < c")
    with pytest.raises(ScriptError):
        parse_expression("count > 1")


def test_joins():
    op = parse('v x = a |> join(b, how: "left", on: ["k", "l"])').statements[0].ops[0]
    assert op.other == "b" and op.on == ("k", "l") and op.how == "left"
    assert parse('v x = a |> join(b, on: "k")').statements[0].ops[0].how == "inner"
    for bad in ('on: "k", how: "right"', 'on: "k", left_on: "l"', 'left_on: ["a", "b"], right_on: "c"', 'right_on: "c"', 'on: "k", on: "l"'):
        with pytest.raises(ScriptError):
            parse(f"v x = a |> join(b, {bad})")


@pytest.mark.parametrize("bad", ["v x = a |> nope(1)", "v x = a |> take(-1)", "v x = a |> sample(0)", 'v x = load("f")', "v x = a |> select([v])", "v x = a |> filter()",
                                 "v x = a |> orderBy(desc: true)", "v x = a |> rename(\"a\")", "let x = a", "type A = { a: Option }"])
def test_parser_refuses(bad):
    with pytest.raises(ScriptError) as e:
        parse(bad)
    assert e.value.category == "parse" and e.value.line == 1


def test_suggestions():
    with pytest.raises(ScriptError, match="did you mean 'filter'"):
        parse("v x = a |> fitler(b > 1)")


def test_charts():
    op = parse('a |> chart { type: bar x: region, y: count title: "t" }').statements[0].ops[0]
    assert op.args == {"kind": "bar", "x": "region", "y": "count", "title": "t"}
    assert parse('a |> chart({ type: pie, label: "l", value: v })').statements[0].ops[0].args["value"] == "v"
    for bad, code in (("type: cube x: a y: b", "VIZ001"), ("x: a y: b", "VIZ001"), ("type: line x: a", "VIZ002"), ("type: pie x: a", "VIZ003"), ("kind: bar", "unknown field")):
        with pytest.raises(ScriptError, match=code):
            parse("a |> chart { " + bad + " }")


def test_models():
    p = parse('model M { Dense(64) -> ReLU() -> Dropout(0.2) -> Softmax() }\nrun d |> train(M, target: "y", epochs: 5, lr: 0.1, batch_size: 8, validation_split: 0.2)')
    assert p.statements[0].layers == (("Dense", 64), ("ReLU", None), ("Dropout", 0.2), ("Softmax", None))
    assert p.statements[1] == T.Train("d", "M", "y", 5, 0.1, 8, 0.2)
    assert parse("run d |> train(M)").statements[0].epochs == 10
    for bad in ("model M { Conv(3) }", "run d |> train(M, rate: 1)"):
        with pytest.raises(ScriptError):
            parse(bad)


def test_all_steps_are_known():
    from tidemill.operators.relational import AGGREGATES, SIMPLE

    assert set(STEPS) == {*SIMPLE, *AGGREGATES, "groupBy", "join"}
