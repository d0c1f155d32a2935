"""A registry of functions that can be called by name, and a calculator.

A call never raises: it returns a value or an error.
"""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}
_NAMED = {"sqrt": math.sqrt, "log": math.log, "exp": math.exp, "sin": math.sin, "cos": math.cos, "abs": abs, "round": round, "min": min, "max": max}
_CONSTANTS = {"pi": math.pi, "e": math.e}
MOST_CHARACTERS, MOST_POWER = 200, 1000


def calculate(expression: str) -> float:
    """The value of an arithmetic expression; anything else is a ValueError."""
    if len(expression) > MOST_CHARACTERS:
        raise ValueError("too long")

    def value(node: ast.AST) -> float:
        match node:
            case ast.Expression(body):
                return value(body)
            case ast.Constant(x) if isinstance(x, int | float) and not isinstance(x, bool):
                return x
            case ast.Name(id) if id in _CONSTANTS:
                return _CONSTANTS[id]
            case ast.BinOp(left, op, right) if type(op) in _BINARY:
                a, b = value(left), value(right)
                if isinstance(op, ast.Pow) and (abs(b) > MOST_POWER or abs(a) > 1e6):
                    raise ValueError("power too large")
                return _BINARY[type(op)](a, b)
            case ast.UnaryOp(op, x) if type(op) in _UNARY:
                return _UNARY[type(op)](value(x))
            case ast.Call(ast.Name(id), args, []) if id in _NAMED:
                return _NAMED[id](*map(value, args))
        raise ValueError("not allowed")

    try:
        return float(value(ast.parse(expression, mode="eval")))
    except (SyntaxError, ArithmeticError, TypeError, RecursionError, MemoryError) as e:
        raise ValueError(str(e)) from e


def _calculated(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> float | None:
        try:
            return None if t is None else calculate(t)
        except ValueError:
            return None

    return texts.map(one).astype("float64")


def safe_calculation(expression: Column) -> Column:
    """The expression's value; null where it has none."""
    return F.pandas_udf(_calculated, DoubleType())(expression)


@dataclass(frozen=True)
class Function:
    name: str
    call: Callable
    arguments: dict[str, type] = field(default_factory=dict)
    optional: frozenset[str] = frozenset()
    about: str = ""

    def schema(self) -> dict:
        kinds = {int: "integer", float: "number", str: "string", bool: "boolean", list: "array"}
        return {"name": self.name, "description": self.about, "parameters": {"type": "object", "properties": {k: {"type": kinds[v]} for k, v in self.arguments.items()}, "required": [k for k in self.arguments if k not in self.optional]}}


class Library:
    """Functions by name."""

    def __init__(self, functions: list[Function]):
        self.functions = {f.name: f for f in functions}

    def schemas(self) -> list[dict]:
        return [f.schema() for f in self.functions.values()]

    def call(self, name: str, arguments: dict) -> dict:
        """{"ok": True, "value": ...} or {"ok": False, "error": ...}: unknown names, unknown, missing or ill-typed arguments, and errors of the function."""
        f = self.functions.get(name)
        if f is None:
            return {"ok": False, "error": f"no function {name}"}
        if unknown := set(arguments) - set(f.arguments):
            return {"ok": False, "error": f"unknown: {', '.join(sorted(unknown))}"}
        if missing := set(f.arguments) - set(arguments) - f.optional:
            return {"ok": False, "error": f"missing: {', '.join(sorted(missing))}"}
        try:
            return {"ok": True, "value": f.call(**{k: f.arguments[k](v) for k, v in arguments.items()})}
        except Exception as e:  # noqa: BLE001  a call reports all errors
            return {"ok": False, "error": f"{type(e).__name__}: {e}"}


def engine_library(spark: SparkSession, sf_dir: str) -> Library:
    """The engine's queries as functions, each giving its first rows, and the calculator."""
    from tessera import plans

    rows = lambda name: lambda limit=10: [r.asDict() for r in plans.QUERIES[name](spark, sf_dir).limit(limit).collect()]
    named = {"search": "hybrid_topk", "answer": "extractive_answers", "plan": "study_plan", "calendar": "plan_calendar", "progress": "mastery_fold", "sources": "source_dedupe"}
    return Library([Function("calculator", calculate, {"expression": str}, about="Arithmetic."), *(Function(k, rows(v), {"limit": int}, frozenset({"limit"}), f"The first rows of {v}.") for k, v in named.items())])
