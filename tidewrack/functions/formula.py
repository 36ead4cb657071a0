"""Formulas that come as data, turned into column expressions.

A formula may hold numbers, column names, ``+ - * / ^ ( )``, ``pi`` and the functions below; anything else is refused.
The text is only checked and rewritten (names quoted, ``^`` as a call), and Spark's own SQL reads the result.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function names that a formula may call, and Spark's name for each.
FUNCTIONS = {"sqrt": "sqrt", "sin": "sin", "cos": "cos", "tan": "tan", "asin": "asin", "log": "ln", "abs": "abs", "exp": "exp"}
#: Texts that stand for no formula.
NONE = ("", "no", "see note", "nan")
_SIGNS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*"}


def to_sql(formula: str, columns: Iterable[str]) -> str:
    """The SQL text of a formula; ValueError names what isn't allowed. Division by zero gives null."""
    known = {c.lower(): c for c in columns}

    def walk(node: ast.AST) -> str:
        if isinstance(node, ast.Expression):
            return walk(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
            return f"{float(node.value)!r}D"
        if isinstance(node, ast.Name):
            if node.id.lower() == "pi":
                return "pi()"
            if node.id.lower() in known:
                return f"cast(`{known[node.id.lower()]}` as double)"
            raise ValueError(f"unknown column {node.id}")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            return f"({'-' if isinstance(node.op, ast.USub) else ''}{walk(node.operand)})"
        if isinstance(node, ast.BinOp):
            a, b = walk(node.left), walk(node.right)
            if isinstance(node.op, ast.Div):
                return f"try_divide({a}, {b})"
            if isinstance(node.op, ast.Pow):
                return f"power({a}, {b})"
            if type(node.op) in _SIGNS:
                return f"({a} {_SIGNS[type(node.op)]} {b})"
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id.lower() in FUNCTIONS and len(node.args) == 1 and not node.keywords:
            return f"{FUNCTIONS[node.func.id.lower()]}({walk(node.args[0])})"
        raise ValueError(f"not allowed in a formula: {ast.unparse(node)}")

    text = re.sub(r"(?<=\d),(?=\d)", ".", formula.strip()).replace("^", "**").replace("π", "pi")
    try:
        return walk(ast.parse(text, mode="eval"))
    except SyntaxError as e:
        raise ValueError(f"not a formula: {formula}") from e


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def formula(text: str, columns: Iterable[str]) -> Column:
    """A formula as a column; null where its value isn't finite."""
    return finite(F.expr(to_sql(text, columns)))


def by_row(which: str, formulas: Iterable[str], columns: Iterable[str]) -> Column:
    """Each row's own formula, named by its column ``which``: one branch for each distinct formula that can be read."""
    columns = list(columns)
    out = F.lit(None).cast("double")
    for text in sorted({f for f in formulas if f is not None and f.strip().lower() not in NONE}):
        try:
            out = F.when(F.col(which) == text, formula(text, columns)).otherwise(out)
        except ValueError:
            continue  # a row with a formula that can't be read gets null, as in the workflow
    return out
