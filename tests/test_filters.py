import math
import random
from decimal import Decimal

import pytest
from engine import commit, make, values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillon import errors as E
from quillon.functions import filters
from quillon.plans.requests import Aggregate, And, Compare, GroupByRequest, Literal, Not, Or, ScanRequest, VectorSearchRequest
from quillon.plans.schema import Schema

NAN = math.nan
C = Compare
OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def naive(f, row):
    """Three-valued: True, False or None."""
    if isinstance(f, Compare):
        x = row[f.column]
        return None if x is None else OPS[f.op](x, f.value.value if isinstance(f.value, Literal) else f.value)
    if isinstance(f, Not):
        x = naive(f.inner, row)
        return None if x is None else not x
    a, b = naive(f.left, row), naive(f.right, row)
    if isinstance(f, And):
        return False if a is False or b is False else None if None in (a, b) else True
    return True if a is True or b is True else None if None in (a, b) else False


@pytest.fixture(scope="module")
def scores(spark, tmp_path_factory):
    ds = make(spark, tmp_path_factory.mktemp("scores"), ("id", "int64", False), ("title", "utf8"), ("score", "int64"), ("active", "bool"), ("ratio", "float64"), ("rank", "uint64"))
    rows = [
        (0, "null", None, True, NAN, Decimal(1)),
        (1, "low", 5, False, 0.0, Decimal(2)),
        (2, "middle", 15, None, -0.0, None),
        (3, "high", 25, False, 5.0, Decimal(2**64 - 1)),
        (4, None, 4, True, None, Decimal(0)),
        (5, "é", 6, None, math.inf, Decimal(3)),
        (6, "low", 5, True, -math.inf, Decimal(4)),
    ]
    commit(ds, *rows[:3])
    commit(ds, *rows[3:])
    names = ds.schema.names
    return ds.snapshot(), [dict(zip(names, r, strict=True)) for r in rows]


def kept(scores, f):
    view, rows = scores
    return [r[0] for r in values(view.scan(ScanRequest(("id",), f)))], [r["id"] for r in rows if naive(f, r) is True]


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("column, value", [("score", 5), ("title", "low"), ("ratio", 0.0), ("ratio", -0.0), ("ratio", NAN), ("ratio", 5.0), ("ratio", math.inf), ("rank", 2)])
def test_comparisons(scores, column, value, op):
    for f in (C(column, op, value), ~C(column, op, value)):
        got, want = kept(scores, f)
        assert got == want


@pytest.mark.parametrize("op", ["=", "!="])
@pytest.mark.parametrize("value", [True, False])
def test_booleans(scores, op, value):
    got, want = kept(scores, C("active", op, value))
    assert got == want


leaves = st.one_of(
    st.builds(C, st.just("score"), st.sampled_from(list(OPS)), st.integers(3, 26)),
    st.builds(C, st.just("ratio"), st.sampled_from(list(OPS)), st.sampled_from([NAN, 0.0, -0.0, 1.0, 5.0, math.inf])),
    st.builds(C, st.just("active"), st.sampled_from(["=", "!="]), st.booleans()),
    st.builds(C, st.just("title"), st.sampled_from(list(OPS)), st.sampled_from(["low", "é", "", "zz"])),
)
trees = st.recursive(leaves, lambda x: st.one_of(st.builds(And, x, x), st.builds(Or, x, x), st.builds(Not, x)), max_leaves=5)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(trees)
def test_trees_equal_the_naive_evaluator_and_pruning_is_sound(scores, f):
    got, want = kept(scores, f)
    assert got == want
    view, rows = scores
    files = view.manifest.files
    pruned = {x.name for x in files} - {x.name for x in view.surviving(f)}
    for x in files:
        if x.name in pruned:
            assert not any(naive(f, r) for r in rows[x.first : x.last + 1])


def test_total_order_predicates(scores):
    view, _ = scores
    ids = lambda f: [r[0] for r in values(view.scan_predicate(f, ["id", "ratio"]).select("id"))]
    assert ids(C("ratio", "=", 0.0)) == [1] and ids(C("ratio", "=", -0.0)) == [2]
    assert ids(C("ratio", "<", 0.0)) == [2, 6] and ids(C("ratio", "<=", -0.0)) == [2, 6] and ids(C("ratio", ">", -0.0)) == [0, 1, 3, 5]
    with pytest.raises(E.UnknownColumn):
        view.scan_predicate(C("ratio", "=", 0.0), ["id"])


def test_pruning_statistics():
    schema = Schema.of(("a", "int64"), ("b", "utf8"), ("c", "float64"), ("u", "uint64"))
    stats = {"a": [10, 20], "b": ["f", "m"], "c": [0.0, 1.0]}
    match = lambda f: filters.may_match(schema, f, stats)
    assert match(C("a", "=", 10)) and not match(C("a", "=", 9)) and not match(C("a", "<", 10)) and match(C("a", "<=", 10)) and not match(C("a", ">", 20)) and match(C("a", ">=", 20))
    assert not match(C("b", "<", "f")) and match(C("b", "=", "g")) and not match(C("b", ">", "é"))
    assert not match(C("c", "=", NAN)) and match(C("c", "!=", NAN))
    assert not match(C("a", "=", 9) & C("u", "=", 1)) and match(C("a", "=", 9) | C("u", "=", 1)) and match(~C("a", "=", 9))
    assert filters.prunable(schema, C("a", "=", 9) & C("u", "=", 1)) and not filters.prunable(schema, C("a", "=", 9) | C("u", "=", 1))


def test_filter_identity():
    assert C("a", "=", 0.0) != C("a", "=", -0.0) and C("a", "=", NAN) == C("a", "==", NAN)
    assert C("a", "=", 1) & C("b", "=", 2) != C("b", "=", 2) & C("a", "=", 1)
    assert (C("a", "=", 1) | ~C("b", "=", 2)).columns() == ["a", "b"]
    assert [Literal.of(x).type for x in (True, 1, 2**63, 1.0, "x")] == ["bool", "int64", "uint64", "float64", "utf8"]
    assert Literal.of(1, "uint64").type == "uint64" and Literal.of(-1, "uint64").type == "int64"


SCHEMA = Schema.of(("id", "int64", False), ("name", "utf8"), ("ok", "bool"), ("x", "float64"), ("vector", "vector[3]"), ("other", "vector[2]"))


@pytest.mark.parametrize(
    "error, check",
    [
        (E.UnknownColumn, lambda s: s.check_scan(ScanRequest(("nope",)))),
        (E.ReservedColumn, lambda s: s.check_scan(ScanRequest(("_row_id",)))),
        (E.DuplicateProjection, lambda s: s.check_scan(ScanRequest(("id", "id")))),
        (E.FilterTypeMismatch, lambda s: s.check_scan(ScanRequest(None, C("x", ">", 1)))),
        (E.FilterTypeMismatch, lambda s: s.check_scan(ScanRequest(None, C("id", "=", "1")))),
        (E.NonScalarFilterColumn, lambda s: s.check_scan(ScanRequest(None, C("vector", "=", 1)))),
        (E.InvalidComparisonOperator, lambda s: s.check_scan(ScanRequest(None, C("ok", "<", True)))),
        (E.UnknownColumn, lambda s: s.check_scan(ScanRequest(("nope",), C("x", ">", 1)))),
        (E.EmptyGroupBy, lambda s: s.check_group_by(GroupByRequest(()))),
        (E.NonScalarGroupColumn, lambda s: s.check_group_by(GroupByRequest(("vector",)))),
        (E.DuplicateGroupColumn, lambda s: s.check_group_by(GroupByRequest(("id", "id")))),
        (E.DuplicateAggregateAlias, lambda s: s.check_group_by(GroupByRequest(("id",), (Aggregate("x", "sum", "id"),)))),
        (E.ReservedColumn, lambda s: s.check_group_by(GroupByRequest(("id",), (Aggregate("x", "sum", "_timestamp"),)))),
        (E.InvalidAggregateType, lambda s: s.check_group_by(GroupByRequest(("id",), (Aggregate("name", "sum", "n"),)))),
        (E.InvalidAggregateType, lambda s: s.check_group_by(GroupByRequest(("id",), (Aggregate("vector", "count", "n"),)))),
        (E.InvalidVectorK, lambda s: s.check_vector_search(VectorSearchRequest((1.0,), 0, "other"))),
        (E.UnsupportedVectorColumn, lambda s: s.check_vector_search(VectorSearchRequest((1.0,), 1, "other"))),
        (E.NonFiniteVectorComponent, lambda s: s.check_vector_search(VectorSearchRequest((NAN,), 1))),
        (E.VectorDimensionMismatch, lambda s: s.check_vector_search(VectorSearchRequest((1.0,), 1))),
        (E.UnknownColumn, lambda s: s.check_vector_search(VectorSearchRequest((1.0, 2.0, 3.0), 1, hydrate=("nope",)))),
        (E.DuplicateSchemaColumn, lambda s: Schema.of(("a", "int64"), ("a", "utf8"))),
        (E.ReservedColumn, lambda s: Schema.of(("_row_id", "int64"))),
        (E.ZeroVectorDimensions, lambda s: Schema.of(("v", "vector[0]"))),
        (E.UnsupportedType, lambda s: Schema.of(("v", "date"))),
    ],
)
def test_validation_errors(error, check):
    with pytest.raises(error) as found:
        check(SCHEMA)
    assert isinstance(found.value, E.InvalidQueryError)


def test_vector_column_must_be_a_vector():
    with pytest.raises(E.NotVectorColumn):
        Schema.of(("vector", "utf8")).check_vector_search(VectorSearchRequest((1.0,), 1))
    with pytest.raises(E.UnknownColumn):
        Schema.of(("id", "int64")).check_vector_search(VectorSearchRequest((1.0,), 1))


def test_random_rows_pruned_equals_unpruned(spark, tmp_path):
    r = random.Random(1)
    ds = make(spark, tmp_path, ("id", "int64"), ("x", "float64"))
    rows = [(i, r.choice([None, NAN, r.random()])) for i in range(90)]
    for i in range(0, 90, 30):
        commit(ds, *rows[i : i + 30])
    view = ds.snapshot()
    for f in (C("id", "<", 30), C("id", ">=", 60) & C("x", "<", 0.5), C("id", "=", 31) | C("id", "=", 89)):
        pruned = values(view.scan(ScanRequest(None, f)))
        whole = values(view.frame().where(filters.condition(ds.schema, f)))
        assert repr(pruned) == repr(whole)
    assert len(view.surviving(C("id", "<", 30))) == 1
