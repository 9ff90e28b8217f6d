"""Formulas over features: checked against a list of functions, then run as SQL expressions."""

from __future__ import annotations

import ast
from collections.abc import Mapping

#: The functions that formulas may use; roots and logarithms are of clipped values.
FUNCTIONS = {
    "sign": "sign({})", "abs": "abs({})", "sqrt": "sqrt(greatest({}, 0))", "square": "power({}, 2)", "log": "ln(greatest({}, 1e-10))",
    "exp": "exp({})", "sin": "sin({})", "cos": "cos({})", "tan": "tan({})",
}
_OPERATORS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}


def formula(text: str, columns: Mapping[str, str]) -> str:
    """A formula as an SQL expression; columns: the variables that it may name, and the columns they stand for.

    Anything but numbers, those variables, + - * / and the listed functions is an error.  A division by zero is null.
    """

    def render(node: ast.expr) -> str:
        match node:
            case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
                return f"cast({v!r} as double)"
            case ast.Name(id=name) if name in columns:
                return columns[name]
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return f"(-{render(x)})"
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                return f"({render(a)} / nullif({render(b)}, 0))"
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPERATORS:
                return f"({render(a)} {_OPERATORS[type(op)]} {render(b)})"
            case ast.Call(func=ast.Name(id=name), args=[x], keywords=[]) if name in FUNCTIONS:
                return FUNCTIONS[name].format(render(x))
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:80]}")

    return render(ast.parse(text, mode="eval").body)


def factor_columns(source: str, equations: Mapping[str, str], columns: Mapping[str, str]) -> str:
    """The source with a column for each named equation."""
    return f"(select *, {', '.join(f'{formula(e, columns)} as {n}' for n, e in equations.items())} from {source} features)"
