from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions import tlv
from tessella.plans.dsl import Leaf, Node, Query, SortKey, parse

names = st.sampled_from(["a", "b_c", "size", "o_key"])
OPS = {"eq": "==", "ne": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
numbers = st.builds(lambda f, o, v: Leaf(f, o, (v,), "integer"), names, st.sampled_from(sorted(OPS)), st.integers(-(10**12), 10**12))
strings = st.builds(lambda f, o, v: Leaf(f, o, (v,), "string"), names, st.sampled_from(["eq", "ne"]), st.text("xyz ;:[],()=<>", max_size=8))
lists = st.builds(lambda f, o, v: Leaf(f, o, tuple(v), "string"), names, st.sampled_from(["in", "nin"]), st.lists(st.text("pq ,]", max_size=4), min_size=1, max_size=3))
ranges = st.builds(lambda f, a, b: Leaf(f, "between", (a, b), "integer"), names, st.integers(-99, 99), st.integers(-99, 99))
exists = st.builds(lambda f: Leaf(f, "exists"), names)
atoms = numbers | strings | lists | ranges | exists
trees = st.recursive(atoms, lambda t: st.builds(lambda op, cs: Node(op, tuple(cs)), st.sampled_from(["and", "or"]), st.lists(t, min_size=2, max_size=3)) | st.builds(lambda c: Node("not", (c,)), t), max_leaves=6)


def text(x) -> str:
    if isinstance(x, Node):
        parts = [f"({text(c)})" for c in x.children]
        return f"not {parts[0]}" if x.op == "not" else f" {x.op} ".join(parts)
    if x.op == "exists":
        return f"exists {x.field}"
    quoted = [f'"{v}"' for v in x.values]
    if x.op in ("in", "nin"):
        return f"{x.field} {'not ' if x.op == 'nin' else ''}in [{', '.join(quoted)}]"
    if x.op == "between":
        return f"int:{x.field} between {x.values[0]} and {x.values[1]}"
    return f"{x.field} {OPS[x.op]} {quoted[0] if x.type == 'string' else x.values[0]}"


@settings(max_examples=200, deadline=None)
@given(trees, st.integers(1, 99), st.integers(0, 9), st.booleans())
def test_text_of_a_tree_parses_to_it(tree, limit, offset, ascending):
    query = Query(tree, (SortKey("a", ascending),), limit, offset)
    again = parse(f"{text(tree)}; sort: {'+' if ascending else '-'}a; limit: {limit}; offset: {offset}")
    assert again == query and again.canonical() == query.canonical()


values = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False) | st.text(max_size=9) | st.binary(max_size=9), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=3), v, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(values)
def test_tlv_round_trip(value):
    assert tlv.decode(tlv.encode(value)) == value
