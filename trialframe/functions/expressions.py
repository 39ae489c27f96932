"""A small expression language, compiled to Spark columns with Python's meaning.

Literals, names, lists, ``+ - * / ** %``, ``and or not``, chained comparisons, ``in`` and
``not in``. ``+`` also joins texts and lists, and ``*`` repeats them, as far as names tell which are texts
or lists. Anything else, such as calls, attributes or subscripts, is refused.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialframe.errors import PlanError


def named(path: str) -> Column:
    """The column called ``path``, dots and all."""
    return F.col("`" + path.replace("`", "``") + "`")


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign."""
    return a - b * F.floor(a / b)


class _List(tuple):
    """The items of a list literal."""


ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: a.cast("double") / b,
    ast.Pow: F.pow,
    ast.Mod: floor_mod,
}
ORDER = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}


class _Compiler(ast.NodeVisitor):
    def __init__(self, names: Mapping[str, Column], lists: frozenset[str], texts: frozenset[str]) -> None:
        self.names, self.lists, self.texts = names, lists, texts

    def kind(self, node: ast.AST) -> str | None:
        """``text``, ``list``, or None for all else, from literals and names."""
        if isinstance(node, ast.Constant):
            return "text" if isinstance(node.value, str) else None
        if isinstance(node, ast.Name):
            return "text" if node.id in self.texts else "list" if node.id in self.lists else None
        if isinstance(node, ast.List | ast.Tuple):
            return "list"
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add | ast.Mult):
            return self.kind(node.left) or self.kind(node.right)
        return None

    def generic_visit(self, node: ast.AST):
        raise PlanError(f"expressions cannot contain {type(node).__name__}")

    def visit_Expression(self, node: ast.Expression):
        return self.visit(node.body)

    def visit_Constant(self, node: ast.Constant):
        if not isinstance(node.value, int | float | str | bool | None):
            raise PlanError(f"literal {node.value!r} has no column type")
        return F.lit(node.value)

    def visit_Name(self, node: ast.Name):
        if node.id not in self.names:
            raise PlanError(f"unknown name {node.id!r}")
        return self.names[node.id]

    def visit_List(self, node: ast.List | ast.Tuple):
        return _List(self.scalar(e) for e in node.elts)

    visit_Tuple = visit_List

    def scalar(self, node: ast.AST) -> Column:
        value = self.visit(node)
        return F.array(*value) if isinstance(value, _List) else value

    def truth(self, node: ast.AST) -> Column:
        return self.scalar(node).cast("boolean")

    def visit_BinOp(self, node: ast.BinOp):
        if type(node.op) not in ARITHMETIC:
            self.generic_visit(node.op)
        left, right = self.scalar(node.left), self.scalar(node.right)
        kinds = [self.kind(node.left), self.kind(node.right)]
        if any(kinds) and isinstance(node.op, ast.Add):
            if kinds[0] != kinds[1]:
                raise PlanError(f"cannot add {kinds[0] or 'a number'} and {kinds[1] or 'a number'}")
            return F.concat(left, right)
        if any(kinds) and isinstance(node.op, ast.Mult):
            if all(kinds):
                raise PlanError(f"cannot multiply {kinds[0]} and {kinds[1]}")
            what, times = (left, right) if kinds[0] else (right, left)
            return F.repeat(what, times.cast("int")) if "text" in kinds else F.flatten(F.array_repeat(what, times.cast("int")))
        if any(kinds):
            raise PlanError(f"no arithmetic but + and * on {kinds[0] or kinds[1]}")
        return ARITHMETIC[type(node.op)](left, right)

    def visit_UnaryOp(self, node: ast.UnaryOp):
        if isinstance(node.op, ast.Not):
            return ~self.truth(node.operand)
        value = self.scalar(node.operand)
        if isinstance(node.op, ast.USub):
            return -value
        return value if isinstance(node.op, ast.UAdd) else self.generic_visit(node.op)

    def visit_BoolOp(self, node: ast.BoolOp):
        join = (lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b)
        return reduce(join, map(self.truth, node.values))

    def membership(self, node: ast.AST, left: Column, right) -> Column:
        if isinstance(right, _List):
            return reduce(lambda a, b: a | b, (left.eqNullSafe(x) for x in right), F.lit(False))
        if isinstance(node, ast.Name) and node.id in self.lists:
            return F.array_contains(right, left)
        return right.contains(left)

    def visit_Compare(self, node: ast.Compare):
        parts, left = [], self.visit(node.left)
        for op, right_node in zip(node.ops, node.comparators, strict=True):
            right = self.visit(right_node)
            if isinstance(op, ast.In | ast.NotIn):
                found = self.membership(right_node, left, right)
                parts.append(found if isinstance(op, ast.In) else ~found)
            elif type(op) in ORDER:
                a, b = (F.array(*x) if isinstance(x, _List) else x for x in (left, right))
                parts.append(ORDER[type(op)](a, b))
            else:
                self.generic_visit(op)
            left = right
        return reduce(lambda a, b: a & b, parts)


def compile_expression(text: str, names: Mapping[str, Column] | list[str] | tuple[str, ...], lists: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> Column:
    """The column of an expression over ``names``: a map to columns, or plain column names.

    ``in`` looks for an item in a list literal or in one of the array columns ``lists``, else for a substring. ``texts`` names the
    text columns, which ``+`` joins.
    """
    columns = dict(names) if isinstance(names, Mapping) else {n: named(n) for n in names}
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise PlanError(f"{text!r}: {e.msg}") from e
    value = _Compiler(columns, frozenset(lists), frozenset(texts)).visit(tree)
    return F.array(*value) if isinstance(value, _List) else value
