"""The expression language for derived columns: a subset of Python syntax compiled to Spark columns.

Nothing is evaluated in Python; names are columns, calls are those of FUNCTIONS,
and anything else is refused.  Division by zero and logarithms or roots outside
their domain do not fail: the former is null, the latter are clamped.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.columns import finite

PREVIEW_ROWS = 100


class ExpressionError(ValueError):
    """The expression uses something outside the language."""


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b))


def _log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-12)))


def _yeo_johnson(x: Column, power: Column | None = None) -> Column:
    k = 0.5 if power is None else power
    up = (F.pow(F.greatest(x, F.lit(0.0)) + 1, F.lit(k)) - 1) / k
    down = -(F.pow(1 - F.least(x, F.lit(0.0)), F.lit(2 - k)) - 1) / (2 - k)
    return F.when(x >= 0, up).otherwise(down)


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "tanh": F.tanh,
    "exp": lambda x: F.exp(F.least(x, F.lit(700.0))),
    "sqrt": lambda x: F.sqrt(F.greatest(x, F.lit(0.0))),
    "log": _log,
    "log10": lambda x: _log(x) / math.log(10),
    "log1p": lambda x: F.log1p(F.greatest(x, F.lit(-0.999999999999))),
    "round": lambda x, d=None: F.bround(x, 0 if d is None else d),
    "clip": lambda x, low, high: F.least(F.greatest(x, low), high),
    "sigmoid": lambda x: 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-50.0)), F.lit(50.0)))),
    "yeojohnson": _yeo_johnson,
    "where": lambda c, a, b: F.when(c, a).otherwise(b),
    "ifelse": lambda c, a, b: F.when(c, a).otherwise(b),
}
#: Functions of a whole column: the name stands for literals found in one aggregation beforehand.
COLUMN_FUNCTIONS = ("zscore", "minmax")
CONSTANTS = {"pi": math.pi, "e": math.e}

_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.FloorDiv: _floor_div,
    ast.Mod: lambda a, b: a - b * _floor_div(a, b),
    ast.Pow: F.pow,
    ast.BitAnd: lambda a, b: a & b,
    ast.BitOr: lambda a, b: a | b,
}
_COMPARE = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}


class _Compiler:
    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def column(self, name: str) -> Column:
        if name in self.df.columns:
            kind = self.df.schema[name].dataType
            return F.col(f"`{name}`") if isinstance(kind, (T.StringType, T.BooleanType)) else finite(F.col(f"`{name}`"))
        if name in CONSTANTS:
            return F.lit(CONSTANTS[name])
        raise ExpressionError(f"unknown name {name}")

    def literal(self, node: ast.AST) -> float | int:
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -self.literal(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return node.value
        raise ExpressionError("a number is expected")

    def __call__(self, node: ast.AST) -> Column:
        match node:
            case ast.Expression():
                return self(node.body)
            case ast.Name():
                return self.column(node.id)
            case ast.Constant(value=bool() | str()):
                return F.lit(node.value)
            case ast.Constant(value=int() | float()):
                return F.lit(float(node.value))
            case ast.BinOp(op=op) if type(op) in _BINARY:
                return _BINARY[type(op)](self(node.left), self(node.right))
            case ast.UnaryOp(op=ast.USub()):
                return -self(node.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return self(node.operand)
            case ast.UnaryOp(op=ast.Not() | ast.Invert()):
                return ~self(node.operand)
            case ast.BoolOp(op=op):
                join = (lambda a, b: a & b) if isinstance(op, ast.And) else (lambda a, b: a | b)
                return reduce(join, map(self, node.values))
            case ast.Compare():
                sides = [self(x) for x in (node.left, *node.comparators)]
                tests = [_COMPARE.get(type(o)) for o in node.ops]
                if None in tests:
                    raise ExpressionError("unsupported comparison")
                return reduce(lambda a, b: a & b, (t(x, y) for t, x, y in zip(tests, sides, sides[1:], strict=False)))
            case ast.IfExp():
                return F.when(self(node.test), self(node.body)).otherwise(self(node.orelse))
            case ast.Call(func=ast.Name(id=name), keywords=[]):
                return self.call(name, node.args)
        raise ExpressionError(f"{type(node).__name__} is not part of the language")

    def call(self, name: str, args: list[ast.expr]) -> Column:
        if name in COLUMN_FUNCTIONS and len(args) == 1:
            return self.of_column(name, self(args[0]))
        if name not in FUNCTIONS:
            raise ExpressionError(f"unknown function {name}")
        if name in ("round", "yeojohnson") and len(args) == 2:
            return FUNCTIONS[name](self(args[0]), self.literal(args[1]))
        try:
            return FUNCTIONS[name](*map(self, args))
        except TypeError:
            raise ExpressionError(f"{name}: wrong number of arguments") from None

    def of_column(self, name: str, x: Column) -> Column:
        """zscore (population deviation) or minmax; 0 everywhere for a constant column."""
        s = self.df.agg(F.avg(x), F.stddev_pop(x), F.min(x), F.max(x)).first()
        low, spread = (s[0], s[1]) if name == "zscore" else (s[2], (s[3] or 0) - (s[2] or 0))
        if low is None or not spread or spread < 1e-12:
            return F.when(x.isNotNull(), F.lit(0.0))
        return (x - low) / spread


def compiled(df: DataFrame, text: str) -> Column:
    """The expression as a column of df."""
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise ExpressionError(str(e)) from None
    return _Compiler(df)(tree)


def derive(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add a derived column."""
    if name in df.columns:
        raise ExpressionError(f"{name} exists")
    return df.withColumn(name, compiled(df, text))


def preview(df: DataFrame, text: str, name: str = "new_var") -> DataFrame:
    """The derived column on the first rows (PREVIEW_ROWS); column statistics are still those of the table."""
    return derive(df, text, name).limit(PREVIEW_ROWS)
