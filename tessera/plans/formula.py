"""Function-style formulas: text to tree, checked against the function registry, then to columns of a panel.

Equal subtrees are one node whatever formula they stand in. Nodes of one depth run together, stage by stage: all
columns of a stage go into one projection, so Spark computes those that share a partitioning with one shuffle.
"""

from __future__ import annotations

import inspect
import itertools
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.registry import OPS, Whole

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|([A-Za-z_]\w*)|('[^']*'|\"[^\"]*\")|(.))")


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """A field, a constant, or a call; args are nodes, named are (name, value) parameters."""

    kind: str
    value: object
    args: tuple[Node, ...] = ()
    named: tuple[tuple[str, object], ...] = ()

    def text(self) -> str:
        if self.kind != "call":
            return repr(self.value) if self.kind == "const" else str(self.value)
        return f"{self.value}({','.join([*(a.text() for a in self.args), *(f'{k}={v!r}' for k, v in self.named)])})"

    def depth(self) -> int:
        return 1 + max((a.depth() for a in self.args), default=0) if self.kind == "call" else 0

    def span(self) -> tuple[float, float]:
        """Rows before and after a date that its value can depend on; infinite where all of them count."""
        back = ahead = 0.0
        if self.kind == "call":
            o = OPS[self.value]
            n = columns_of(o, self.args)
            back, ahead = o.span(n, [a.value for a in self.args[n:]], dict(self.named))
        spans = [a.span() for a in self.args]
        return back + max((b for b, _ in spans), default=0), ahead + max((a for _, a in spans), default=0)

    def history(self) -> float:
        """Rows before a date that its value can depend on: the warm-up a date filter must leave."""
        return self.span()[0]

    def fields(self) -> set[str]:
        return {str(self.value)} if self.kind == "field" else set().union(*(a.fields() for a in self.args))


def columns_of(o, args: tuple[Node, ...]) -> int:
    """How many of a call's first arguments are columns."""
    return max(len(args), len(o.inputs) - 1) if o.inputs.endswith("*") else len(o.inputs)


def call(name: str, args: list[Node], named: list[tuple[str, object]]) -> Node:
    """A call; where constants stand between the columns that a function takes, the columns come first."""
    if name in OPS:
        n, columns = columns_of(OPS[name], tuple(args)), [a for a in args if a.kind != "const"]
        if len(columns) >= n and any(a.kind == "const" for a in args[:n]):
            args = [*columns, *(a for a in args if a.kind == "const")]
    return Node("call", name, tuple(args), tuple(sorted(named)))


def parse(text: str) -> Node:
    """Nested calls, field names, numbers, strings and name=value parameters; operators are functions too."""
    tokens = [m.groups() for m in _TOKEN.finditer(text.strip())]
    at = 0

    def peek() -> str | None:
        return next((t for t in tokens[at] if t is not None), None) if at < len(tokens) else None

    def take(what: str | None = None) -> str:
        nonlocal at
        got = peek()
        if got is None or (what and got != what):
            raise FormulaError(f"expected {what or 'more'} at token {at} of {text!r}")
        at += 1
        return got

    def constant() -> object:
        sign = -1 if peek() == "-" and take() else 1
        number, name, quoted, _ = tokens[at] if at < len(tokens) else (None,) * 4
        take()
        if number:
            return sign * (float(number) if re.search(r"[.eE]", number) else int(number))
        if quoted:
            return quoted[1:-1]
        if name in ("True", "False", "None"):
            return {"True": True, "False": False, "None": None}[name]
        raise FormulaError(f"not a constant in {text!r}")

    def expression() -> Node:
        if at >= len(tokens):
            raise FormulaError(f"{text!r} ends too early")
        number, name, quoted, other = tokens[at]
        if name is None or name in ("True", "False", "None"):
            return Node("const", constant())
        take()
        if peek() != "(":
            return Node("field", name)
        take("(")
        args, named = [], []
        while peek() != ")":
            if at + 1 < len(tokens) and tokens[at][1] and tokens[at + 1][3] == "=":
                key = take()
                take("=")
                named.append((key, constant()))
            elif named:
                raise FormulaError(f"a place after a name in {text!r}")
            else:
                args.append(expression())
            if peek() == ",":
                take()
            elif peek() != ")":
                raise FormulaError(f"expected , or ) in {text!r}")
        take(")")
        return call(name, args, named)

    out = expression()
    if at != len(tokens):
        raise FormulaError(f"{text!r} goes on after its end")
    return out


def check(node: Node, kinds: dict[str, str]) -> str:
    """The node's kind (f, c, g); raises FormulaError for unknown names, wrong kinds or parameters. kinds: of fields."""
    if node.kind == "const":
        return "f"
    if node.kind == "field":
        if node.value not in kinds:
            raise FormulaError(f"unknown field {node.value}")
        return kinds[str(node.value)]
    if node.value not in OPS:
        raise FormulaError(f"unknown function {node.value}")
    o = OPS[str(node.value)]
    n = columns_of(o, node.args)
    if len(node.args) < n:
        raise FormulaError(f"{node.value} takes {n} columns")
    for want, arg in zip(o.inputs.rstrip("*").ljust(n, o.inputs.rstrip("*")[-1:] or "f"), node.args):
        got = check(arg, kinds)
        if got != want:
            raise FormulaError(f"{node.value} takes {want}, not {got}: {arg.text()}")
    rest = node.args[n:]
    if any(a.kind != "const" for a in rest):
        raise FormulaError(f"parameters of {node.value} are constants")
    try:
        inspect.signature(o.build).bind(*node.args, **dict(node.named))
    except TypeError as e:
        raise FormulaError(f"{node.value}: {e}") from None
    return o.out


KINDS = {"double": "f", "float": "f", "boolean": "c", "int": "g"}


def _started(node: Node, column) -> tuple:
    o = OPS[node.value]
    n = columns_of(o, node.args)
    args = [column(a) for a in node.args[:n]] + [a.value for a in node.args[n:]]
    return o.build(*args, **dict(node.named))


def evaluate(panel: DataFrame, formulas: dict[str, str | Node], kinds: dict[str, str] | None = None) -> DataFrame:
    """panel(date, di, sym, fields) to (date, di, sym, one column per formula). A formula is text or a tree."""
    kinds = kinds or {k: KINDS[t] for k, t in panel.dtypes if t in KINDS and k not in ("di",)}
    roots = {name: f if isinstance(f, Node) else parse(f) for name, f in formulas.items()}
    nodes: dict[Node, int] = {}

    def visit(n: Node) -> None:
        for a in n.args:
            visit(a)
        if n.kind == "call":
            nodes.setdefault(n, n.depth())

    for r in roots.values():
        check(r, kinds)
        visit(r)
    need = sorted(set().union(*(r.fields() for r in roots.values())))
    df = panel.select("date", "di", "sym", *(F.col(f) for f in need))
    name_of: dict[Node, str] = {}
    fresh = (f"_{k}" for k in itertools.count())

    def column(n: Node):
        return F.lit(n.value) if n.kind == "const" else F.col(str(n.value)) if n.kind == "field" else F.col(name_of[n])

    for depth in sorted(set(nodes.values())):
        running = []
        done: dict[str, object] = {}
        for n in (n for n, d in nodes.items() if d == depth):
            made = _started(n, column)
            if inspect.isgenerator(made):
                running.append((n, made, None))
            else:
                name_of[n] = next(fresh)
                done[name_of[n]] = made
        while running:
            stage, whole, waiting = {}, {}, []
            for n, gen, sent in running:
                try:
                    asked = gen.send(sent)
                    names = {k: next(fresh) for k in asked}
                    stage |= {names[k]: c for k, c in asked.items() if not isinstance(c, Whole)}
                    whole |= {names[k]: c.value for k, c in asked.items() if isinstance(c, Whole)}
                    waiting.append((n, gen, {k: F.col(v) for k, v in names.items()}))
                except StopIteration as e:
                    name_of[n] = next(fresh)
                    done[name_of[n]] = e.value
            if stage or done:
                df = df.withColumns(stage | done)
                done = {}
            if whole:
                df = df.crossJoin(F.broadcast(df.agg(*(c.alias(k) for k, c in whole.items()))))
            running = waiting
        if done:
            df = df.withColumns(done)
    return df.select("date", "di", "sym", *(column(r).alias(name) for name, r in roots.items()))
