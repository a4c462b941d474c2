"""Scalar expressions of the DSL and their lowering to Spark columns.

Predicates are two-valued: a comparison with null is false, ``!=`` with null is true, and negation works on
the two-valued operand. Arithmetic, ``least`` and casts keep nulls. Values of different kinds are never equal
and cannot be ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LITERALS = (str, int, float, bool, type(None))
COMPARE, LOGIC, MATH = ("eq", "ne", "lt", "le", "gt", "ge"), ("and", "or", "not"), ("add", "sub", "mul", "div")


@dataclass(frozen=True, eq=False)
class Expr:
    op: str
    args: tuple = ()

    def __bool__(self):
        raise TypeError("an expression has no truth value; use &, | and ~")

    __hash__ = None

    def __eq__(self, o):
        return _binary("eq", self, o)

    def __ne__(self, o):
        return _binary("ne", self, o)

    def __lt__(self, o):
        return _binary("lt", self, o)

    def __le__(self, o):
        return _binary("le", self, o)

    def __gt__(self, o):
        return _binary("gt", self, o)

    def __ge__(self, o):
        return _binary("ge", self, o)

    def __and__(self, o):
        return Expr("and", (predicate(self), predicate(o)))

    def __or__(self, o):
        return Expr("or", (predicate(self), predicate(o)))

    def __invert__(self):
        return Expr("not", (predicate(self),))

    def __add__(self, o):
        return _binary("add", self, o)

    def __radd__(self, o):
        return _binary("add", o, self)

    def __sub__(self, o):
        return _binary("sub", self, o)

    def __rsub__(self, o):
        return _binary("sub", o, self)

    def __mul__(self, o):
        return _binary("mul", self, o)

    def __rmul__(self, o):
        return _binary("mul", o, self)

    def __truediv__(self, o):
        return _binary("div", self, o)

    def __rtruediv__(self, o):
        return _binary("div", o, self)

    def isin(self, values: Iterable) -> Expr:
        values = tuple(values)
        if not all(isinstance(v, LITERALS) for v in values):
            raise TypeError("isin takes literals")
        return Expr("isin", (self, values))

    def is_null(self) -> Expr:
        return Expr("is_null", (self,))

    def is_not_null(self) -> Expr:
        return Expr("is_not_null", (self,))

    def array_cat(self, other) -> Expr:
        return Expr("array_cat", (self, expr(other)))

    @property
    def is_predicate(self) -> bool:
        return self.op in COMPARE + LOGIC + ("isin", "is_null", "is_not_null")

    def columns(self) -> set[tuple[str, str | None]]:
        if self.op == "col":
            return {self.args}
        return set().union(*(a.columns() for a in self.args if isinstance(a, Expr))) if self.args else set()

    def to_param(self) -> dict:
        return {"op": self.op, "args": [a.to_param() if isinstance(a, Expr) else list(a) if isinstance(a, tuple) else a for a in self.args]}

    @staticmethod
    def from_param(p: dict) -> Expr:
        return Expr(p["op"], tuple(Expr.from_param(a) if isinstance(a, dict) else tuple(a) if isinstance(a, list) else a for a in p["args"]))


def expr(value) -> Expr:
    if isinstance(value, Expr):
        return value
    if isinstance(value, LITERALS):
        return Expr("lit", (value,))
    raise TypeError(f"not an expression or literal: {value!r}")


def _binary(op: str, a, b) -> Expr:
    return Expr(op, (expr(a), expr(b)))


def predicate(e) -> Expr:
    if not isinstance(e, Expr) or not (e.is_predicate or e.op in ("col", "lit", "case_when")):
        raise TypeError("a predicate is needed")
    return e


def col(name: str, qualifier: str | None = None) -> Expr:
    return Expr("col", (name, qualifier))


def lit(value) -> Expr:
    return expr(value)


def least(*values) -> Expr:
    if len(values) < 2:
        raise ValueError("least takes two or more values")
    return Expr("least", tuple(map(expr, values)))


def try_cast(value, to: str = "float") -> Expr:
    if to != "float":
        raise ValueError("only float can be cast to")
    return Expr("try_cast", (expr(value),))


def case_when(condition: Expr, then, otherwise) -> Expr:
    return Expr("case_when", (predicate(condition), expr(then), expr(otherwise)))


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "time"
    return "null" if isinstance(t, T.NullType) else t.typeName()


Resolve = Callable[[str, str | None], tuple[Column, T.DataType]]
_ORDER = {"lt": Column.__lt__, "le": Column.__le__, "gt": Column.__gt__, "ge": Column.__ge__}
_MATH = {"add": Column.__add__, "sub": Column.__sub__, "mul": Column.__mul__, "div": Column.__truediv__}


def lower(e: Expr, resolve: Resolve, bare_equality: bool = False) -> tuple[Column, T.DataType]:
    """Column and type. ``bare_equality``: leave a top ``=`` uncoalesced, for join keys (null never matches there)."""
    if e.op == "col":
        return resolve(*e.args)
    if e.op == "lit":
        v = e.args[0]
        kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}
        return (F.lit(v).cast("long") if type(v) is int else F.lit(v)), kinds[type(v)]
    if e.op in ("isin", "is_null", "is_not_null"):
        c, t = lower(e.args[0], resolve)
        if e.op != "isin":
            return (c.isNull() if e.op == "is_null" else c.isNotNull()), T.BooleanType()
        same = [v for v in e.args[1] if v is not None and _kind(lower(expr(v), resolve)[1]) == _kind(t)]
        out = F.coalesce(c.isin(*same), F.lit(False)) if same else F.lit(False)
        return (out | c.isNull() if None in e.args[1] else out), T.BooleanType()
    parts = [lower(a, resolve) for a in e.args]
    cols, types = [p[0] for p in parts], [p[1] for p in parts]
    if e.op in COMPARE:
        kinds = {_kind(t) for t in types} - {"null"}
        if len(kinds) > 1:
            if e.op in _ORDER:
                raise TypeError(f"cannot order {sorted(kinds)}")
            return F.lit(e.op == "ne"), T.BooleanType()
        if e.op == "eq":
            return (cols[0] == cols[1] if bare_equality else F.coalesce(cols[0] == cols[1], F.lit(False))), T.BooleanType()
        if e.op == "ne":
            return F.coalesce(cols[0] != cols[1], F.lit(True)), T.BooleanType()
        return F.coalesce(_ORDER[e.op](cols[0], cols[1]), F.lit(False)), T.BooleanType()
    if e.op in LOGIC:
        if any(_kind(t) not in ("boolean", "null") for t in types):
            raise TypeError("a logical operand is not boolean")
        two = [F.coalesce(c.cast("boolean"), F.lit(False)) for c in cols]
        return (~two[0] if e.op == "not" else two[0] & two[1] if e.op == "and" else two[0] | two[1]), T.BooleanType()
    if e.op in MATH:
        if any(_kind(t) not in ("number", "null") for t in types):
            raise TypeError("arithmetic takes numbers")
        whole = e.op != "div" and all(isinstance(t, T.IntegralType) for t in types)
        return _MATH[e.op](cols[0], cols[1]), T.LongType() if whole else T.DoubleType()
    if e.op == "least":
        return F.least(*cols), next((t for t in types if _kind(t) != "null"), T.NullType())
    if e.op == "try_cast":
        c = cols[0].try_cast("double")
        return F.when(~F.isnan(c), c), T.DoubleType()
    if e.op == "case_when":
        when = F.coalesce(cols[0].cast("boolean"), F.lit(False))
        return F.when(when, cols[1]).otherwise(cols[2]), types[1] if _kind(types[1]) != "null" else types[2]
    if e.op == "array_cat":
        if any(_kind(t) not in ("array", "null") for t in types):
            raise TypeError("array_cat takes arrays")
        t = next((t for t in types if _kind(t) == "array"), T.ArrayType(T.StringType()))
        return F.concat(*(F.coalesce(c.cast(t), F.array().cast(t)) for c in cols)), t
    raise ValueError(f"unknown expression {e.op}")
