"""The language's tree, shared by scripts and the fluent API."""

from __future__ import annotations

from dataclasses import dataclass, field

# Expressions


@dataclass(frozen=True)
class Col:
    name: str


@dataclass(frozen=True)
class Lit:
    value: int | float | str | bool


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


Expr = Col | Lit | Binary


# Sources


@dataclass(frozen=True)
class Load:
    path: str
    schema: str


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Op:
    """One step: its name and its arguments by name."""

    name: str
    args: dict = field(default_factory=dict)
    line: int = 0

    def __getattr__(self, key):
        if key.startswith("__"):
            raise AttributeError(key)
        return self.args.get(key)


# Statements


@dataclass(frozen=True)
class TypeDecl:
    name: str
    fields: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Assign:
    name: str
    source: Load | Ref
    ops: tuple[Op, ...]
    mutable: bool = False


@dataclass(frozen=True)
class Perform:
    """A pipeline that is run for its sinks and not kept."""

    source: Ref
    ops: tuple[Op, ...]


@dataclass(frozen=True)
class Model:
    name: str
    layers: tuple[tuple[str, float | None], ...]


@dataclass(frozen=True)
class Train:
    source: str
    model: str
    target: str = ""
    epochs: int = 10
    lr: float = 0.01
    batch_size: int | None = None
    validation_split: float | None = None


@dataclass
class Program:
    statements: list = field(default_factory=list)
