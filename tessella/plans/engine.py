"""The engine: a query text, tree or builder over one catalog of tables to a lazy DataFrame of ids."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidQueryError, UnsupportedOperatorError
from tessella.functions.tokenizers import SIMPLE, Tokenizer
from tessella.operators import set_ops
from tessella.operators.fulltext import FullTextIndex, SearchOptions
from tessella.plans import predicates
from tessella.plans.dsl import Leaf, Node, Query, Text, leaves, parse, split_text


@dataclass(frozen=True)
class Result:
    """df: the page; all_rows: everything that matched, before paging."""

    df: DataFrame
    all_rows: DataFrame

    def total(self) -> int:
        return self.all_rows.count()

    def with_total(self) -> DataFrame:
        """The page with total_count, from one more aggregation in the same plan."""
        return self.df.withColumn("total_count", self.all_rows.agg(F.count("*")).scalar())


class Engine:
    """entities: one row an id with any columns; tags: (tag, id); docs: (id, content). Each is optional."""

    def __init__(self, entities: DataFrame | None = None, *, tags: DataFrame | None = None, docs: DataFrame | None = None, id_col: str = "id", tokenizer: Tokenizer = SIMPLE, strict: bool = False, search: SearchOptions | None = None) -> None:
        self.entities = entities.withColumnRenamed(id_col, "id") if entities is not None and id_col != "id" else entities
        self.tags, self.docs, self.tokenizer, self.strict = tags, docs, tokenizer, strict
        self.search = search or SearchOptions()
        self._kept: dict[str, DataFrame] = {}

    @staticmethod
    def parsed(query) -> Query:
        return parse(query) if isinstance(query, str) else query.build() if hasattr(query, "build") else query

    # tag leaves
    @staticmethod
    def tag_of(leaf: Leaf, value) -> int:
        """type and category are virtual fields over parts of the tag space."""
        return 1000 + int(value) - 1 if leaf.field == "type" else 2000 + int(value) if leaf.field == "category" else int(value)

    def universe(self) -> DataFrame:
        for table in (self.entities, self.tags, self.docs):
            if table is not None:
                return table.select("id").distinct()
        raise InvalidQueryError("the engine has no tables")

    def _tag_ids(self, leaf: Leaf) -> DataFrame:
        if self.tags is None:
            raise InvalidQueryError("the engine has no tags")
        wanted = [self.tag_of(leaf, v) for v in leaf.values]
        if leaf.op in ("eq", "in"):
            return set_ops.any_of(self.tags, wanted)
        if leaf.op in ("ne", "nin"):
            return set_ops.none_of(self.tags, wanted, self.universe())
        raise UnsupportedOperatorError(f"{leaf.op} isn't defined for tags")

    def _text_index(self) -> FullTextIndex:
        if self.docs is None:
            raise InvalidQueryError("the engine has no documents")
        return FullTextIndex(self.docs, self.tokenizer)

    def ids(self, condition) -> DataFrame:
        """Distinct ids of a tree with tag or text leaves."""
        special = [x for x in leaves(condition) if isinstance(x, Text) or x.type == "tag"]
        if not special:
            if self.entities is None:
                raise InvalidQueryError("the engine has no entities")
            return self.entities.where(predicates.column(self.entities, condition, self.strict)).select("id")
        if isinstance(condition, Text):
            return self._text_index().scores(condition.terms, self.search).select("id")
        if isinstance(condition, Leaf):
            return self._tag_ids(condition)
        if condition.op == "not":
            return set_ops.difference(self.universe(), self.ids(condition.children[0]))
        plain = [c for c in condition.children if isinstance(c, Leaf) and c.type == "tag" and c.op == "eq"]
        rest = [c for c in condition.children if c not in plain]
        columns = [c for c in rest if not any(isinstance(x, Text) or x.type == "tag" for x in leaves(c))]
        others = [c for c in rest if c not in columns]
        sets = [self.ids(c) for c in others]
        if columns:
            sets.insert(0, self.ids(columns[0] if len(columns) == 1 else Node(condition.op, tuple(columns))))
        if plain:
            wanted = [self.tag_of(c, c.values[0]) for c in plain]
            sets.append(set_ops.all_of(self.tags, wanted) if condition.op == "and" else set_ops.any_of(self.tags, wanted))
        return (set_ops.intersect_all if condition.op == "and" else set_ops.union_all)(sets)

    def query(self, query, columns: list[str] | None = None) -> Result:
        """columns: what to return of the entities beside id; scores come with text."""
        q = self.parsed(query)
        texts, rest = split_text(q.condition)
        if texts:
            # text has the score, so it's the left side; predicates narrow it, and paging comes last
            found = self._text_index().scores(" ".join(t.terms for t in texts), self.search)
            if rest is not None:
                found = set_ops.intersect(found, self.ids(rest))
            if columns or any(k.field not in ("id", "score") for k in q.sort):
                found = found.join(self.entities, "id")
            order = [(F.asc if k.ascending else F.desc)(k.field) for k in q.sort] or [F.desc("score")]
            picked = ["id", "score", *(columns or [])]
        else:
            if q.condition is None:
                found = self.entities if self.entities is not None else self.universe()
            elif self.entities is not None and not any(isinstance(x, Text) or x.type == "tag" for x in leaves(q.condition)):
                found = self.entities.where(predicates.column(self.entities, q.condition, self.strict))
            else:
                found = self.ids(q.condition)
                if self.entities is not None and (columns or any(k.field != "id" for k in q.sort)):
                    found = set_ops.intersect(self.entities, found)
            order = [(F.asc if k.ascending else F.desc)(k.field) for k in q.sort if k.field in found.columns]
            picked = ["id", *(columns or [])]
        if "deleted" in found.columns:
            found = found.where(~F.coalesce(F.col("deleted"), F.lit(False)))
        page = found
        if q.sort or q.limit > 0 or q.offset > 0 or texts:
            page = page.orderBy(*order, F.asc("id"))
        page = page.offset(q.offset) if q.offset > 0 else page
        page = page.limit(q.limit) if q.limit > 0 else page
        return Result(page.select(*dict.fromkeys(picked)), found)

    def cached(self, query, columns: list[str] | None = None, capacity: int = 100) -> DataFrame:
        """A result kept by the canonical form of its query; the least recently used go first."""
        key = self.parsed(query).canonical() + repr(columns)
        found = self._kept.pop(key, None)
        if found is None:
            found = self.query(query, columns).df.persist()
        self._kept[key] = found
        while len(self._kept) > capacity:
            self._kept.pop(next(iter(self._kept))).unpersist()
        return found

    def explain(self, query) -> str:
        """The tree as JSON."""
        return self.parsed(query).canonical()

    def with_search(self, **options) -> Engine:
        other = Engine(self.entities, tags=self.tags, docs=self.docs, tokenizer=self.tokenizer, strict=self.strict)
        other.search = replace(self.search, **options)
        return other
