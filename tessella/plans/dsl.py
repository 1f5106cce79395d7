"""The query language: text to a tree of frozen dataclasses.

    query   := part (';' part)*
    part    := 'limit:' INT | 'offset:' INT | 'sort:' key (',' key)* | condition
    condition := any ('and' any)*          'and' is the outer level, so `a and b or c` is a and (b or c)
    any     := one ('or' one)*
    one     := 'not' one | '(' condition ')' | 'exists' field | 'text:' terms
             | field 'between' value 'and' value | field ['not'] 'in' '[' values ']' | field OP value

Of several condition parts the last one counts. Literals are typed int, float, bool, string in this order unless the
field has a prefix tag: int: float: bool: date: str: or the literal is quoted.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from tessella.errors import InvalidQueryError, InvalidValueError, QuerySyntaxError

COMPARISONS = {"==": "eq", "!=": "ne", ">=": "gte", "<=": "lte", ">": "gt", "<": "lt", "contains": "contains", "startswith": "startswith", "endswith": "endswith", "matches": "matches"}
PREFIXES = {"tag": "tag", "int": "integer", "float": "float", "bool": "boolean", "date": "date", "str": "string"}
TRUE, FALSE = frozenset("1 t T TRUE true True".split()), frozenset("0 f F FALSE false False".split())
_KEYWORDS = frozenset("and or not in between exists contains startswith endswith matches".split())
_LEX = re.compile(r"""\s*(?:(?P<text>text:(?:"[^"]+"|[^\s;()"]+))|(?P<quoted>"[^"]*"|'[^']*')|(?P<op>>=|<=|==|!=|>|<)|(?P<mark>[()\[\],])|(?P<word>[^\s()\[\],<>=!"']+|[=!]))""")


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    values: tuple = ()
    type: str = "string"


@dataclass(frozen=True)
class Text:
    terms: str


@dataclass(frozen=True)
class Node:
    op: str  # and, or, not
    children: tuple


@dataclass(frozen=True)
class SortKey:
    field: str
    ascending: bool = True


@dataclass(frozen=True)
class Query:
    condition: Leaf | Text | Node | None = None
    sort: tuple[SortKey, ...] = ()
    limit: int = -1
    offset: int = 0

    def canonical(self) -> str:
        """The whole tree as JSON: what plans and results are known by."""
        return json.dumps(_plain(self), sort_keys=True, default=str)


def _plain(x):
    if isinstance(x, (Leaf, Text, Node, Query, SortKey)):
        return {"kind": type(x).__name__, **{k: _plain(getattr(x, k)) for k in asdict(x)}}
    return [_plain(v) for v in x] if isinstance(x, (tuple, list)) else x


def literal(text: str, kind: str | None = None, quoted: bool = False):
    """(value, type) of a literal; kind None: by its looks."""
    if kind is None:
        if quoted:
            return text, "string"
        if re.fullmatch(r"[+-]?\d+", text):
            return int(text), "integer"
        try:
            return float(text), "float"
        except ValueError:
            return (text in TRUE, "boolean") if text in TRUE | FALSE else (text, "string")
    try:
        if kind in ("integer", "tag"):
            return int(text), kind
        if kind == "float":
            return float(text), kind
    except ValueError:
        raise InvalidValueError(f"{text!r} is no {kind}") from None
    if kind == "boolean":
        if text not in TRUE | FALSE:
            raise InvalidValueError(f"{text!r} is no boolean")
        return text in TRUE, kind
    return text, kind


def split_parts(text: str) -> list[str]:
    """Cuts at ; outside quotes."""
    return [p.strip() for p in re.findall(r"""(?:"[^"]*"|'[^']*'|[^;"']|["'])+""", text) if p.strip()]


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, end = 0, len(text.rstrip())
        while at < end:
            m = _LEX.match(text, at)
            if not m or m.end() == at:
                raise QuerySyntaxError(f"can't read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def word(self, *which: str) -> bool:
        if self.peek()[0] == "word" and self.peek()[1] in which:
            self.at += 1
            return True
        return False

    def expect(self, kind: str, value: str) -> None:
        if self.take() != (kind, value):
            raise QuerySyntaxError(f"{value!r} is missing")

    def joined(self, word: str, lower):
        children = [lower()]
        while self.word(word):
            children.append(lower())
        return children[0] if len(children) == 1 else Node(word, tuple(children))

    def condition(self):
        return self.joined("and", lambda: self.joined("or", self.one))

    def one(self):
        if self.word("not"):
            return Node("not", (self.one(),))
        if self.peek() == ("mark", "("):
            self.take()
            inner = self.condition()
            self.expect("mark", ")")
            return inner
        if self.peek()[0] == "text":
            return Text(self.take()[1][5:].strip('"'))
        if self.word("exists"):
            name, kind = self.field()
            return Leaf(name, "exists", (), kind or "string")
        name, kind = self.field()
        if self.word("between"):
            low = self.value()
            if not self.word("and"):
                raise QuerySyntaxError("between needs two values joined by and")
            return self.leaf(name, "between", [low, self.value()], kind or "string")
        negated = self.peek()[1] == "not" and self.peek(1)[1] == "in" and self.word("not")
        if self.word("in"):
            self.expect("mark", "[")
            values = [self.value()]
            while self.peek() == ("mark", ","):
                self.take()
                values.append(self.value())
            self.expect("mark", "]")
            return self.leaf(name, "nin" if negated else "in", values, kind or "string")
        _, op = self.take()
        if op not in COMPARISONS:
            raise QuerySyntaxError(f"{op!r} is no comparison")
        text_op = op in ("contains", "startswith", "endswith", "matches")
        return self.leaf(name, COMPARISONS[op], [self.value()], "string" if text_op else kind)

    def leaf(self, name: str, op: str, raw: list[tuple[str, bool]], kind: str | None) -> Leaf:
        typed = [literal(text, kind, quoted) for text, quoted in raw]
        return Leaf(name, op, tuple(v for v, _ in typed), typed[0][1])

    def field(self) -> tuple[str, str | None]:
        kind, text = self.take()
        if kind != "word" or text in _KEYWORDS:
            raise QuerySyntaxError(f"a field was expected at {text!r}")
        prefix, colon, rest = text.partition(":")
        if colon and prefix in PREFIXES:
            if not rest:
                raise QuerySyntaxError(f"{text!r} names no field")
            return rest, PREFIXES[prefix]
        return text, None

    def value(self) -> tuple[str, bool]:
        kind, text = self.take()
        if kind == "quoted":
            return text[1:-1], True
        if kind != "word":
            raise QuerySyntaxError("a value is missing")
        parts = [text]
        while self.peek()[0] == "word" and self.peek()[1] not in _KEYWORDS:
            parts.append(self.take()[1])
        return " ".join(parts), False


def parse_condition(text: str):
    parser = _Parser(text)
    found = parser.condition()
    if parser.peek()[0] != "end":
        raise QuerySyntaxError(f"unexpected {parser.peek()[1]!r}")
    return found


def parse(text: str) -> Query:
    """The tree of a query text."""
    parts = split_parts(text)
    if not parts:
        raise InvalidQueryError("the query is empty")
    condition, sort, limit, offset = None, (), -1, 0
    for part in parts:
        head, colon, rest = part.partition(":")
        head = head.strip()
        if colon and head in ("limit", "offset"):
            try:
                number = int(rest)
            except ValueError:
                raise InvalidValueError(f"{part!r} needs a whole number") from None
            limit, offset = (number, offset) if head == "limit" else (limit, number)
        elif colon and head == "sort":
            keys = [k.strip() for k in rest.split(",") if k.strip()]
            sort = tuple(SortKey(k.lstrip("+-").strip(), not k.startswith("-")) for k in keys)
        else:
            condition = parse_condition(part)
    if condition is not None and limit == -1 and isinstance(condition, Text):
        limit = 10  # a query of text alone returns a page
    return Query(condition, sort, limit, offset)


def leaves(condition) -> list:
    if condition is None:
        return []
    return [x for c in condition.children for x in leaves(c)] if isinstance(condition, Node) else [condition]


def split_text(condition):
    """(text leaves that every result must match, the rest) of a conjunction; (None, condition) if text stands elsewhere."""
    if isinstance(condition, Text):
        return [condition], None
    if isinstance(condition, Node) and condition.op == "and":
        texts = [c for c in condition.children if isinstance(c, Text)]
        rest = tuple(c for c in condition.children if not isinstance(c, Text))
        if texts and not any(isinstance(x, Text) for c in rest for x in leaves(c)):
            return texts, rest[0] if len(rest) == 1 else Node("and", rest) if rest else None
    return [], condition
