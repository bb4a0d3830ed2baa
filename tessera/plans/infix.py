"""Infix expressions to formula trees, read by Python's own expression grammar and never evaluated."""

from __future__ import annotations

import ast

from .formula import FormulaError, Node, call as made

_BINARY = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div", ast.BitAnd: "con_and", ast.BitOr: "con_or"}
_COMPARE = {ast.Gt: "GT", ast.Lt: "LT", ast.GtE: "ge", ast.LtE: "le", ast.Eq: "eq", ast.NotEq: "NE"}


def parse_infix(text: str) -> Node:
    """`a*(b-DELAY(b,1)) > c` style text; fields may carry a $ sign. Comparisons, & and | give conditions."""
    try:
        tree = ast.parse(text.replace("$", ""), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"{text!r}: {e.msg}") from None

    def call(name: str, *args: Node) -> Node:
        return Node("call", name, args)

    def value(n: ast.expr) -> object:
        got = convert(n)
        if got.kind != "const":
            raise FormulaError(f"not a constant in {text!r}")
        return got.value

    def convert(n: ast.expr) -> Node:
        match n:
            case ast.Constant(value=v):
                return Node("const", v)
            case ast.Name(id=v):
                return Node("field", v)
            case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=v)):
                return Node("const", -v)
            case ast.UnaryOp(op=ast.USub(), operand=v):
                return call("neg", convert(v))
            case ast.UnaryOp(op=ast.Invert() | ast.Not(), operand=v):
                return call("con_not", convert(v))
            case ast.BinOp(left=a, op=o, right=b) if type(o) in _BINARY:
                return call(_BINARY[type(o)], convert(a), convert(b))
            case ast.BinOp(left=a, op=ast.Pow(), right=b):
                return call("power", convert(a), Node("const", value(b)))
            case ast.BoolOp(op=o, values=vs):
                out = convert(vs[0])
                for v in vs[1:]:
                    out = call("con_and" if isinstance(o, ast.And) else "con_or", out, convert(v))
                return out
            case ast.Compare(left=a, ops=[o], comparators=[b]) if type(o) in _COMPARE:
                return call(_COMPARE[type(o)], convert(a), convert(b))
            case ast.IfExp(test=c, body=a, orelse=b):
                return call("WHERE", convert(c), convert(a), convert(b))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=named):
                return made(name, [convert(a) for a in args], [(k.arg, value(k.value)) for k in named])
        raise FormulaError(f"{ast.dump(n)} has no meaning in {text!r}")

    return convert(tree)
