"""A fluent form of the query tree: where("a").eq(1).and_("b").gt(2).order_by("-a").limit(5)."""

from __future__ import annotations

from tessella.plans.dsl import Leaf, Node, Query, SortKey, Text


def _type_of(value) -> str:
    return "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "float" if isinstance(value, float) else "string"


class QueryBuilder:
    def __init__(self) -> None:
        self._all: list[list] = []  # conjunction of disjunctions
        self._field, self._type, self._or = "", None, False
        self._sort: list[SortKey] = []
        self._limit, self._offset = -1, 0

    def where(self, field: str, type: str | None = None) -> QueryBuilder:
        self._field, self._type, self._or = field, type, False
        return self

    and_ = where

    def or_(self, field: str, type: str | None = None) -> QueryBuilder:
        self._field, self._type, self._or = field, type, True
        return self

    def _add(self, leaf) -> QueryBuilder:
        if self._or and self._all:
            self._all[-1].append(leaf)
        else:
            self._all.append([leaf])
        return self

    def _leaf(self, op: str, *values, type: str | None = None) -> QueryBuilder:
        return self._add(Leaf(self._field, op, values, self._type or type or (_type_of(values[0]) if values else "string")))

    def eq(self, v) -> QueryBuilder:
        return self._leaf("eq", v)

    def ne(self, v) -> QueryBuilder:
        return self._leaf("ne", v)

    def gt(self, v) -> QueryBuilder:
        return self._leaf("gt", v)

    def gte(self, v) -> QueryBuilder:
        return self._leaf("gte", v)

    def lt(self, v) -> QueryBuilder:
        return self._leaf("lt", v)

    def lte(self, v) -> QueryBuilder:
        return self._leaf("lte", v)

    def between(self, low, high) -> QueryBuilder:
        return self._leaf("between", low, high)

    def in_(self, *values) -> QueryBuilder:
        return self._leaf("in", *values)

    def not_in(self, *values) -> QueryBuilder:
        return self._leaf("nin", *values)

    def exists(self) -> QueryBuilder:
        return self._leaf("exists")

    def contains(self, v: str) -> QueryBuilder:
        return self._leaf("contains", v, type="string")

    def startswith(self, v: str) -> QueryBuilder:
        return self._leaf("startswith", v, type="string")

    def endswith(self, v: str) -> QueryBuilder:
        return self._leaf("endswith", v, type="string")

    def matches(self, v: str) -> QueryBuilder:
        return self._leaf("matches", v, type="string")

    def full_text(self, terms: str) -> QueryBuilder:
        self._or = False
        return self._add(Text(terms))

    def order_by(self, *keys: str) -> QueryBuilder:
        self._sort += [SortKey(k.lstrip("+-"), not k.startswith("-")) for k in keys]
        return self

    def limit(self, n: int) -> QueryBuilder:
        self._limit = n
        return self

    def offset(self, n: int) -> QueryBuilder:
        self._offset = n
        return self

    def paginate(self, page: int, size: int) -> QueryBuilder:
        return self.offset((page - 1) * size).limit(size)

    def build(self) -> Query:
        parts = tuple(x[0] if len(x) == 1 else Node("or", tuple(x)) for x in self._all)
        condition = parts[0] if len(parts) == 1 else Node("and", parts) if parts else None
        return Query(condition, tuple(self._sort), self._limit, self._offset)


def where(field: str, type: str | None = None) -> QueryBuilder:
    return QueryBuilder().where(field, type)
