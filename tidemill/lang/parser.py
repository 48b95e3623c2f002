"""Tokens to a tree.

Steps are read by one routine from the table ``STEPS``, which gives each step's
positional and named arguments and how each is read.
"""

from __future__ import annotations

from . import tree as T
from .errors import ScriptError, did_you_mean
from .lexer import KEYWORDS, Token, tokenize

#: name -> (positional arguments, named arguments, least number of positional ones); an argument is (name, reader).
STEPS: dict[str, tuple[list[tuple[str, str]], dict[str, str], int]] = {
    "filter": ([("where", "expr")], {}, 1),
    "select": ([("columns", "names")], {}, 1),
    "count": ([("column", "string")], {}, 0),
    "groupBy": ([("key", "string")], {}, 1),
    **{name: ([("column", "string")], {}, 1) for name in ("sum", "mean", "min", "max", "median", "variance", "std")},
    "orderBy": ([("column", "string")], {"desc": "bool"}, 1),
    "take": ([("n", "natural")], {}, 1),
    "dropNull": ([("column", "string")], {}, 1),
    "fillNull": ([("column", "string"), ("value", "scalar")], {}, 2),
    "join": ([("other", "word")], {"on": "keys", "left_on": "keys", "right_on": "keys", "how": "string"}, 1),
    "withColumn": ([("column", "string"), ("value", "expr")], {}, 2),
    "cast": ([("column", "string"), ("to", "string")], {}, 2),
    "rename": ([("old", "string"), ("new", "string")], {}, 2),
    "replace": ([("column", "string"), ("old", "string"), ("new", "string")], {}, 3),
    "sample": ([("n", "natural")], {"seed": "int"}, 1),
}
JOIN_KINDS = ("inner", "left", "outer", "cross")
CHART_NEEDS = {"bar": ("x", "y"), "line": ("x", "y"), "scatter": ("x", "y"), "pie": ("label", "value")}
LAYERS = {"Dense": "int", "Dropout": "number", "ReLU": None, "Sigmoid": None, "Tanh": None, "Softmax": None, "BatchNorm": None}
TRAINING = {"target": "string", "epochs": "natural", "lr": "number", "batch_size": "natural", "validation_split": "number"}
COMPARE = ("==", "!=", "<", ">", "<=", ">=")


class Parser:
    def __init__(self, text: str):
        self.tokens = tokenize(text)
        self.at = 0

    # Tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, message: str, hint: str | None = None):
        raise ScriptError("parse", message, self.now.line, self.now.col, hint)

    def next(self) -> Token:
        got = self.now
        self.at += got.kind != "end"
        return got

    def eat(self, text: str) -> bool:
        if self.now.text == text and self.now.kind in ("symbol", "keyword"):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.eat(text):
            self.fail(f"expected '{text}', found '{self.now.text or 'the end'}'")

    def word(self, what: str = "a name") -> str:
        if self.now.kind != "word":
            self.fail(f"expected {what}, found '{self.now.text or 'the end'}'", 'reserved words can be columns as col("...")' if self.now.text in KEYWORDS else None)
        return self.next().text

    def read(self, reader: str):
        """One argument."""
        kind = self.now.kind
        if reader == "expr":
            return self.expr()
        if reader == "word":
            return self.word()
        if reader == "string" and kind == "string":
            return self.next().value
        if reader in ("int", "natural") and kind == "int":
            if reader == "natural" and self.now.value < 0:
                self.fail("expected a number of 0 or more")
            return self.next().value
        if reader == "number" and kind in ("int", "float"):
            return float(self.next().value)
        if reader == "scalar" and kind in ("int", "float", "string"):
            return self.next().value
        if reader == "bool" and self.now.text in ("true", "false"):
            return self.next().text == "true"
        if reader == "names":
            return self.listed(self.word)
        if reader == "keys":
            return self.listed(lambda: self.read("string")) if self.now.text == "[" else (self.read("string"),)
        self.fail(f"expected a {reader}, found '{self.now.text or 'the end'}'")

    def listed(self, item) -> tuple:
        self.need("[")
        out = []
        while self.now.text != "]":
            out.append(item())
            if not self.eat(","):
                break
        self.need("]")
        return tuple(out)

    # Statements

    def program(self) -> T.Program:
        out = T.Program()
        while self.now.kind != "end":
            out.statements.append(self.statement())
            self.eat(";")
        return out

    def statement(self):
        if self.eat("type"):
            return self.type_decl()
        if self.now.text in ("v", "mut") and self.now.kind == "keyword":
            mutable = self.eat("mut")
            self.need("v")
            name = self.word("a variable's name")
            self.need("=")
            return T.Assign(name, *self.pipeline(), mutable)
        if self.eat("model"):
            return self.model()
        if self.eat("run"):
            return self.train()
        if self.now.kind == "word" and self.tokens[self.at + 1].text == "|>":
            return T.Perform(*self.pipeline())
        self.fail(f"a statement cannot begin with '{self.now.text}'", did_you_mean(self.now.text, ["type", "v", "mut", "model", "run"]))

    def type_decl(self) -> T.TypeDecl:
        name = self.word("a type's name")
        self.need("=")
        self.need("{")
        fields = []
        while self.now.text != "}":
            field = self.word("a field's name")
            self.need(":")
            if self.eat("Option"):
                self.need("<")
                kind = f"Option<{self.word('a type')}>"
                self.need(">")
            else:
                kind = self.word("a type")
            fields.append((field, kind))
            if not self.eat(","):
                break
        self.need("}")
        return T.TypeDecl(name, tuple(fields))

    def model(self) -> T.Model:
        name = self.word("a model's name")
        self.need("{")
        layers = []
        while self.now.text != "}":
            kind = self.word("a layer")
            if kind not in LAYERS:
                self.fail(f"unknown layer '{kind}'; there are {', '.join(LAYERS)}", did_you_mean(kind, LAYERS))
            self.need("(")
            layers.append((kind, self.read(LAYERS[kind]) if LAYERS[kind] else None))
            self.need(")")
            if not self.eat("->"):
                break
        self.need("}")
        return T.Model(name, tuple(layers))

    def train(self) -> T.Train:
        source = self.word("a variable")
        self.need("|>")
        self.need("train")
        self.need("(")
        model, given = self.word("a model"), {}
        while self.eat(","):
            name = self.next().text
            if name not in TRAINING:
                self.fail(f"unknown argument '{name}' of train; there are {', '.join(TRAINING)}")
            self.need(":")
            given[name] = self.read(TRAINING[name])
        self.need(")")
        return T.Train(source, model, **given)

    # Pipelines

    def pipeline(self):
        if self.eat("load"):
            self.need("(")
            path = self.read("string")
            self.need(")")
            self.need("::")
            source = T.Load(path, self.word("a type's name"))
        else:
            source = T.Ref(self.word("load(...) or a variable"))
        ops = []
        while self.eat("|>"):
            ops.append(self.step())
        return source, tuple(ops)

    def step(self) -> T.Op:
        line, name = self.now.line, self.now.text
        if name == "chart":
            self.next()
            return T.Op("chart", self.chart(), line)
        if name not in STEPS:
            self.fail(f"unknown step '{name}'; there are {', '.join([*STEPS, 'chart'])}", did_you_mean(name, STEPS))
        self.next()
        positional, named, least = STEPS[name]
        args: dict = {}
        if self.now.text != "(" and not least:
            return T.Op(name, args, line)
        self.need("(")
        while self.now.text != ")":
            if len(args) < len(positional) and not any(k in named for k in args):
                key, reader = positional[len(args)]
                args[key] = self.read(reader)
            else:
                key = self.now.text
                if key not in named:
                    self.fail(f"unexpected '{key}' in {name}", did_you_mean(key, named))
                if key in args:
                    self.fail(f"'{key}' is given twice")
                self.next()
                self.need(":")
                args[key] = self.read(named[key])
            if not self.eat(","):
                break
        if len(args) < least:
            self.fail(f"{name} needs {least} argument{'s' * (least > 1)}")
        self.need(")")
        self.checked(name, args)
        return T.Op(name, args, line)

    def checked(self, name: str, args: dict) -> None:
        if name == "sample" and args["n"] < 1:
            self.fail("sample needs a number of at least 1")
        if name == "join":
            kind = args.setdefault("how", "inner")
            if kind not in JOIN_KINDS:
                self.fail(f"unknown kind of join '{kind}'; there are {', '.join(JOIN_KINDS)}", did_you_mean(kind, JOIN_KINDS))
            sides = [k for k in ("left_on", "right_on") if k in args]
            if "on" in args and sides:
                self.fail("join takes either on or left_on and right_on")
            if len(sides) == 1 or len(args.get("left_on", ())) != len(args.get("right_on", ())):
                self.fail("left_on and right_on need the same number of columns")

    def chart(self) -> dict:
        round_ = self.eat("(")
        self.need("{")
        out: dict = {}
        while self.now.text != "}":
            self.eat(",")
            key = self.now.text
            if key == "}":
                break
            if key not in ("type", "title", "x", "y", "label", "value"):
                self.fail(f"unknown field '{key}' of chart; there are type, x, y, label, value, title")
            self.next()
            self.need(":")
            if key == "title":
                out[key] = self.read("string")
            elif self.now.kind in ("word", "keyword", "string"):
                out["kind" if key == "type" else key] = self.next().value
            else:
                self.fail(f"expected a name for '{key}'")
        self.need("}")
        if round_:
            self.need(")")
        kind = out.get("kind")
        if kind not in CHART_NEEDS:
            self.fail(f"VIZ001: {'unknown chart type ' + repr(kind) if kind else 'chart without a type'}; there are {', '.join(CHART_NEEDS)}", did_you_mean(kind or "", CHART_NEEDS))
        missing = [k for k in CHART_NEEDS[kind] if k not in out]
        if missing:
            self.fail(f"{'VIZ003' if kind == 'pie' else 'VIZ002'}: a {kind} chart needs {' and '.join(CHART_NEEDS[kind])}")
        return out

    # Expressions: one comparison at most, then + and -, then * and /

    def expr(self):
        left = self.sum_()
        if self.now.text in COMPARE and self.now.kind == "symbol":
            op = self.next().text
            left = T.Binary(op, left, self.sum_())
            if self.now.text in COMPARE and self.now.kind == "symbol":
                self.fail("comparisons cannot be chained; use parentheses")
        return left

    def sum_(self):
        left = self.product()
        while self.now.text in ("+", "-") and self.now.kind == "symbol":
            left = T.Binary(self.next().text, left, self.product())
        return left

    def product(self):
        left = self.atom()
        while self.now.text in ("*", "/") and self.now.kind == "symbol":
            left = T.Binary(self.next().text, left, self.atom())
        return left

    def atom(self):
        got = self.now
        if got.kind in ("int", "float", "string"):
            return T.Lit(self.next().value)
        if got.text in ("true", "false") and got.kind == "keyword":
            return T.Lit(self.next().text == "true")
        if self.eat("("):
            inner = self.expr()
            self.need(")")
            return inner
        name = self.word("a column or a value")
        if name == "col" and self.now.text == "(":
            self.next()
            name = self.read("string")
            self.need(")")
        return T.Col(name)


def parse(text: str) -> T.Program:
    return Parser(text).program()


def parse_expression(text: str) -> T.Expr:
    p = Parser(text)
    out = p.expr()
    if p.now.kind != "end":
        p.fail(f"unexpected '{p.now.text}' after the expression")
    return out
