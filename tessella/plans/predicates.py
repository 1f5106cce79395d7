"""Leaves of the query tree to Catalyst columns. Absent fields and failed coercions are null, so they match nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import InvalidFieldTypeError, UnsupportedOperatorError
from tessella.plans.dsl import FALSE, TRUE, Leaf, Node

ORDERED = frozenset(("eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "between", "exists"))
ALLOWED = {
    "string": frozenset(("eq", "ne", "contains", "startswith", "endswith", "matches", "in", "nin", "between", "exists")),
    "text": frozenset(("contains", "exists")),
    "integer": ORDERED,
    "float": ORDERED,
    "date": ORDERED,
    "boolean": frozenset(("eq", "ne", "in", "nin", "exists")),
}
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")


def to_date(c: Column) -> Column:
    """The first of the three layouts that fits; without a zone, UTC."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def coerced(column: Column, stored: T.DataType, kind: str, strict: bool = False) -> Column:
    """A stored value as the type that the condition declares; strict: failures raise instead of being null."""
    to = (lambda c, t: c.cast(t)) if strict else (lambda c, t: c.try_cast(t))
    number = isinstance(stored, T.NumericType)
    if kind == "string":
        return column.cast("string")
    if kind == "integer":
        return to(column, "bigint") if number or isinstance(stored, T.StringType) else F.lit(None).cast("bigint")
    if kind == "float":
        return to(column, "double") if number or isinstance(stored, T.StringType) else F.lit(None).cast("double")
    if kind == "boolean":
        if number:
            return column != 0
        if isinstance(stored, T.StringType):
            return F.when(column.isin(*TRUE), True).when(column.isin(*FALSE), False)
        return column.cast("boolean")
    if kind == "date":
        return column if isinstance(stored, (T.TimestampType, T.TimestampNTZType, T.DateType)) else to_date(column.cast("string"))
    raise InvalidFieldTypeError(kind)


def leaf(df: DataFrame, x: Leaf, strict: bool = False) -> Column:
    if x.type not in ALLOWED:
        raise InvalidFieldTypeError(x.type)
    if x.op not in ALLOWED[x.type]:
        raise UnsupportedOperatorError(f"{x.op} isn't defined for {x.type}")
    fields = {f.name: f.dataType for f in df.schema.fields}
    if x.field not in fields:
        return F.lit(False)
    raw = F.col(f"`{x.field}`")
    if x.op == "exists":
        return raw.isNotNull()
    c = coerced(raw, fields[x.field], x.type, strict)
    values = [to_date(F.lit(v)) if x.type == "date" and isinstance(v, str) else F.lit(v) for v in x.values]
    match x.op:
        case "eq":
            return c == values[0]
        case "ne":
            return c != values[0]
        case "gt":
            return c > values[0]
        case "gte":
            return c >= values[0]
        case "lt":
            return c < values[0]
        case "lte":
            return c <= values[0]
        case "between":
            return c.between(values[0], values[1])
        case "in" | "nin":
            hit = c.isin(*values) if x.type == "date" else c.isin(*x.values)
            return hit if x.op == "in" else ~hit
        case "contains":
            return c.contains(values[0])
        case "startswith":
            return c.startswith(values[0])
        case "endswith":
            return c.endswith(values[0])
        case "matches":
            return c.rlike(x.values[0])
    raise UnsupportedOperatorError(x.op)


def column(df: DataFrame, condition, strict: bool = False) -> Column:
    """A tree without tag and text leaves as one column; Catalyst pushes what it can into the scan."""
    if isinstance(condition, Node):
        parts = [column(df, c, strict) for c in condition.children]
        if condition.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if condition.op == "and" else out | p
        return out
    return leaf(df, condition, strict)
