"""Errors with a category, a place in the script and, where there is one, a suggestion."""

from __future__ import annotations

import difflib
from collections.abc import Iterable


class ScriptError(Exception):
    """category: lex, parse, name, type or data."""

    def __init__(self, category: str, message: str, line: int = 0, col: int = 0, hint: str | None = None):
        self.category, self.message, self.line, self.col, self.hint = category, message, line, col, hint
        super().__init__(str(self))

    def __str__(self) -> str:
        place = f" [Line {self.line}: Col {self.col}]" if self.line else ""
        return f"{self.category} error{place}: {self.message}" + (f" ({self.hint})" if self.hint else "")


def did_you_mean(name: str, known: Iterable[str]) -> str | None:
    close = difflib.get_close_matches(name, list(known), n=1, cutoff=0.6)
    return f"did you mean '{close[0]}'?" if close else None


def unknown_column(name: str, known: Iterable[str]) -> ScriptError:
    known = list(known)
    return ScriptError("name", f"no column '{name}' among {', '.join(known)}", hint=did_you_mean(name, known))
