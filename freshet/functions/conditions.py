"""Row conditions written as in a notebook, as Column expressions.

Python reads the text; what it finds is translated piece by piece, and every
piece that is not listed here is refused, so a condition can name columns and
values and nothing else.
"""

from __future__ import annotations

import ast
import datetime as dt
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A column in back-ticks, a value by its name, or a text, in which neither is looked for.
_MARKED = re.compile(r"`(?P<column>[^`]*)`|@(?P<value>[A-Za-z_]\w*)|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"")
_COMPARED: dict[type, Callable[[Column, Column], Column]] = {
    ast.Eq: lambda a, b: F.coalesce(a == b, F.lit(False)),
    ast.NotEq: lambda a, b: F.coalesce(a != b, F.lit(True)),
    ast.Lt: lambda a, b: F.coalesce(a < b, F.lit(False)),
    ast.LtE: lambda a, b: F.coalesce(a <= b, F.lit(False)),
    ast.Gt: lambda a, b: F.coalesce(a > b, F.lit(False)),
    ast.GtE: lambda a, b: F.coalesce(a >= b, F.lit(False)),
}
_COMPUTED = {ast.Add: Column.__add__, ast.Sub: Column.__sub__, ast.Mult: Column.__mul__, ast.Div: Column.__truediv__}


def condition(text: str, values: Mapping[str, object] | None = None) -> Column:
    """A condition such as ``site == 'A' and 0 < depth <= @limit and season in ['winter', 'spring']``.

    It may hold ``and``, ``or``, ``not`` (also ``&``, ``|``, ``~``), chained
    comparisons, ``in`` and ``not in`` a list, ``+ - * /``, numbers, texts, True
    and False, columns (in back-ticks where they are no Python names) and
    ``@names`` of ``values``. A missing value is equal to nothing and unequal
    to everything, as in a data frame of the notebook. Anything else raises
    ``ValueError``.
    """
    columns: dict[str, str] = {}

    def plain(match: re.Match) -> str:
        if match["value"] is not None:
            return f"_value_{match['value']}"
        if match["column"] is None:
            return match[0]
        name = f"_column_{len(columns)}"
        columns[name] = match["column"]
        return name

    written = _MARKED.sub(plain, text.replace("\n", " ").strip())
    try:
        tree = ast.parse(written, mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"no condition: {text!r}") from e

    def refuse(node: ast.AST) -> ValueError:
        return ValueError(f"{type(node).__name__} has no place in a condition: {text!r}")

    def listed(node: ast.AST) -> list:
        if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
            return [constant(e) for e in node.elts]
        if isinstance(node, ast.Name) and node.id.startswith("_value_"):
            return list(given(node))
        raise refuse(node)

    def given(node: ast.Name) -> object:
        name = node.id.removeprefix("_value_")
        if name not in (values or {}):
            raise ValueError(f"no value is given for @{name}")
        return values[name]

    def constant(node: ast.AST) -> object:
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
            return -constant(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float, str)):
            return node.value
        raise refuse(node)

    def operand(node: ast.AST) -> Column:
        if isinstance(node, ast.Name):
            if node.id.startswith("_value_"):
                found = given(node)
                if not isinstance(found, (bool, int, float, str, dt.date, dt.datetime)):
                    raise ValueError(f"@{node.id.removeprefix('_value_')} must be one value here")
                return F.lit(found)
            return F.col(f"`{columns.get(node.id, node.id)}`")
        if isinstance(node, ast.BinOp) and type(node.op) in _COMPUTED:
            return _COMPUTED[type(node.op)](operand(node.left), operand(node.right))
        return F.lit(constant(node))

    def compared(node: ast.Compare) -> Column:
        sides, found = [node.left, *node.comparators], None
        for op, a, b in zip(node.ops, sides, sides[1:]):
            if isinstance(op, (ast.In, ast.NotIn)):
                inside = F.coalesce(operand(a).isin(listed(b)), F.lit(False))
                one = ~inside if isinstance(op, ast.NotIn) else inside
            elif type(op) in _COMPARED:
                one = _COMPARED[type(op)](operand(a), operand(b))
            else:
                raise refuse(op)
            found = one if found is None else found & one
        return found

    def truth(node: ast.AST) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [truth(v) for v in node.values]
            join = Column.__and__ if isinstance(node.op, ast.And) else Column.__or__
            found = parts[0]
            for part in parts[1:]:
                found = join(found, part)
            return found
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            join = Column.__and__ if isinstance(node.op, ast.BitAnd) else Column.__or__
            return join(truth(node.left), truth(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Not, ast.Invert)):
            return ~truth(node.operand)
        if isinstance(node, ast.Compare):
            return compared(node)
        if isinstance(node, ast.Name) and not node.id.startswith("_value_"):
            return F.coalesce(operand(node).cast("boolean"), F.lit(False))
        if isinstance(node, ast.Constant) and isinstance(node.value, bool):
            return F.lit(node.value)
        raise refuse(node)

    return truth(tree)
