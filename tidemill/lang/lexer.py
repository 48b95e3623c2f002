"""Script text to tokens, by one regular expression."""

from __future__ import annotations

import re
from typing import NamedTuple

from .errors import ScriptError

# Fixed values of the language: words that are never identifiers.
KEYWORDS = frozenset(
    "type load filter select count v mut Option groupBy sum mean min max orderBy take dropNull fillNull join withColumn on how"
    " true false desc chart cast rename replace left_on right_on sample median variance std seed model run train epochs lr target strategy".split()
)
ESCAPES = {"n": "\n", "t": "\t"}


class Token(NamedTuple):
    kind: str  # word, keyword, int, float, string, symbol or end
    text: str
    value: object
    line: int
    col: int


_RULES = re.compile(
    r"""(?P<space>[\s]+|//[^\n]*)
      |(?P<number>(?:(?<![\w)\]"])-)?\d[\d_]*(?:\.\d[\d_]*)?)
      |(?P<word>[^\W\d]\w*)
      |(?P<string>"(?:\\.|[^"\\])*")
      |(?P<symbol>\|>|::|->|==|!=|<=|>=|[-+*/<>=(){}\[\],:;])""",
    re.X | re.S,
)


def tokenize(text: str) -> list[Token]:
    tokens: list[Token] = []
    at, line, start = 0, 1, 0
    while at < len(text):
        m = _RULES.match(text, at)
        if not m:
            what = "string without an end" if text[at] == '"' else f"unexpected character {text[at]!r}"
            raise ScriptError("lex", what, line, at - start + 1)
        kind, got = m.lastgroup, m.group()
        where = (line, at - start + 1)
        if kind == "number":
            plain = got.replace("_", "")
            if "." in plain:
                tokens.append(Token("float", got, float(plain), *where))
            else:
                if not -(2**63) <= int(plain) < 2**63:
                    raise ScriptError("lex", f"integer {got} does not fit 64 bits", *where)
                tokens.append(Token("int", got, int(plain), *where))
        elif kind == "word":
            tokens.append(Token("keyword" if got in KEYWORDS else "word", got, got, *where))
        elif kind == "string":
            tokens.append(Token("string", got, re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), got[1:-1], flags=re.S), *where))
        elif kind == "symbol":
            tokens.append(Token("symbol", got, got, *where))
        breaks = got.count("\n")
        if breaks:
            line += breaks
            start = at + got.rindex("\n") + 1
        at = m.end()
    tokens.append(Token("end", "", None, line, at - start + 1))
    return tokens
