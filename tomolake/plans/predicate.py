"""Predicates as text: a small dialect, parsed to Columns and never evaluated.

Comparisons of columns and literals, ``and``/``or``/``not`` (also ``&``/``|``/``~``),
``in`` and ``not in`` a list, ``is None``, unary minus and parentheses.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomolake.errors import SchemaError

_COMPARE = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
}


def predicate(text: str, columns: list[str]) -> Column:
    """``text`` as a boolean Column over ``columns``; SchemaError for anything outside the dialect."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise SchemaError(f"cannot parse predicate {text!r}: {e}") from None

    def literal(n: ast.AST):
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float, str, bool)):
            return n.value
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub) and isinstance(n.operand, ast.Constant) and isinstance(n.operand.value, (int, float)):
            return -n.operand.value
        raise SchemaError(f"not a literal in {text!r}")

    def value(n: ast.AST) -> Column:
        if isinstance(n, ast.Name):
            if n.id not in columns:
                raise SchemaError(f"unknown column {n.id!r} in {text!r}")
            return F.col(f"`{n.id}`")
        return F.lit(literal(n))

    def test(n: ast.AST) -> Column:
        if isinstance(n, ast.BoolOp):
            parts = [test(v) for v in n.values]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if isinstance(n.op, ast.And) else (out | p)
            return out
        if isinstance(n, ast.BinOp) and isinstance(n.op, (ast.BitAnd, ast.BitOr)):
            a, b = test(n.left), test(n.right)
            return a & b if isinstance(n.op, ast.BitAnd) else a | b
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.Not, ast.Invert)):
            return ~test(n.operand)
        if isinstance(n, ast.Compare):
            out, left = None, n.left
            for op, right in zip(n.ops, n.comparators, strict=True):
                if isinstance(op, (ast.In, ast.NotIn)):
                    if not isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                        raise SchemaError(f"'in' takes a list in {text!r}")
                    c = value(left).isin([literal(x) for x in right.elts])
                    c = ~c if isinstance(op, ast.NotIn) else c
                elif isinstance(op, (ast.Is, ast.IsNot)) and isinstance(right, ast.Constant) and right.value is None:
                    c = value(left).isNull() if isinstance(op, ast.Is) else value(left).isNotNull()
                elif type(op) in _COMPARE:
                    c = _COMPARE[type(op)](value(left), value(right))
                else:
                    raise SchemaError(f"comparison not supported in {text!r}")
                out, left = c if out is None else out & c, right
            return out
        if isinstance(n, ast.Name) and n.id in columns:
            return value(n).cast("boolean")
        if isinstance(n, ast.Constant) and isinstance(n.value, bool):
            return F.lit(n.value)
        raise SchemaError(f"not a predicate: {text!r}")

    return test(tree)


def where(df: DataFrame, text: str) -> DataFrame:
    return df.where(predicate(text, df.columns))
