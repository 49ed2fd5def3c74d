import math
from collections import defaultdict

import pytest
from engine import commit, make, values

from quillon import errors as E
from quillon.operators import primitive
from quillon.plans.requests import Aggregate, Compare, GroupByRequest

FIELDS = (("category", "utf8"), ("amount", "int64"), ("selected", "bool", False), ("ratio", "float64"))
ALL = tuple(Aggregate("amount", f, f) for f in ("count", "sum", "min", "max", "avg"))


def test_groups_merge_across_files_and_skip_nulls(spark, tmp_path):
    ds = make(spark, tmp_path, *FIELDS)
    commit(ds, ("a", 1, True, 0.5), ("b", 2, True, 2.0), (None, None, True, None))
    commit(ds, ("a", 4, True, 1.5), ("all-null", None, True, None))
    view = ds.snapshot()
    got = {r[0]: tuple(r)[1:] for r in view.group_by(GroupByRequest(("category",), ALL)).collect()}
    assert got == {"a": (2, 5, 1, 4, 2.5), "b": (1, 2, 2, 2, 2.0), None: (0, None, None, None, None), "all-null": (0, None, None, None, None)}
    assert view.group_by(GroupByRequest(("category",), ALL, Compare("amount", ">", 99))).count() == 0
    assert values(view.group_by(GroupByRequest(("category",)))) == [("a",), ("all-null",), ("b",), (None,)]


def test_float_keys_by_bits_and_nan_ignored_by_max(spark, tmp_path):
    ds = make(spark, tmp_path, *FIELDS)
    commit(ds, ("a", 1, True, 0.0), ("a", 2, True, -0.0), ("a", 3, True, math.nan), ("a", 4, True, math.nan), ("b", 5, True, math.nan), ("a", 6, True, None))
    view = ds.snapshot()
    got = sorted((str(r.ratio), r.n) for r in view.group_by(GroupByRequest(("ratio",), (Aggregate("amount", "count", "n"),))).collect())
    assert got == [("-0.0", 1), ("0.0", 1), ("None", 1), ("nan", 3)]
    made = {r.category: (r.lo, r.hi) for r in view.group_by(GroupByRequest(("category",), (Aggregate("ratio", "min", "lo"), Aggregate("ratio", "max", "hi")))).collect()}
    assert made["a"][1] == 0.0 and made["a"][0] == 0.0 and all(math.isnan(x) for x in made["b"])


def test_integer_overflow_names_the_alias(spark, tmp_path):
    ds = make(spark, tmp_path, *FIELDS)
    commit(ds, ("overflow", 2**63 - 1, True, 1.0), ("overflow", 1, True, 1.0))
    with pytest.raises(E.Int64SumOverflow) as found:
        ds.snapshot().collect_groups(GroupByRequest(("category",), (Aggregate("amount", "sum", "total"),)))
    assert found.value.alias == "total"


def test_many_groups_equal_a_dictionary(spark, tmp_path):
    ds = make(spark, tmp_path, ("category", "utf8"), ("amount", "int64"))
    rows = [(f"group-{i % 2500}", i % 997) for i in range(5000)]
    commit(ds, *rows)
    want = defaultdict(list)
    for c, a in rows:
        want[c].append(a)
    got = ds.snapshot().group_by(GroupByRequest(("category",), ALL[:4]))
    assert {tuple(r) for r in got.collect()} == {(c, len(a), sum(a), min(a), max(a)) for c, a in want.items()}


def test_grouping_plans_two_phases_and_reads_two_columns(spark, tmp_path):
    ds = make(spark, tmp_path, *FIELDS)
    commit(ds, ("a", 1, True, 0.5))
    plan = ds.snapshot().group_by(GroupByRequest(("category",), ALL))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "ReadSchema: struct<category:string,amount:bigint>" in plan


def test_primitive_groups(spark):
    df = spark.createDataFrame([("east", "a", 10), ("east", "a", 20), ("west", "a", 30), ("east", "b", 40), ("east", "b", None)], "region string, category string, amount long")
    got = primitive.group_by(df, ["region", "category"], [("amount", "sum"), ("amount", "count"), ("amount", "avg"), ("amount", "min"), ("amount", "max")])
    assert got.columns == ["region", "category", "amount_sum", "amount_count", "amount_avg", "amount_min", "amount_max"]
    assert values(got) == [("east", "a", 30.0, 2, 15.0, 10.0, 20.0), ("east", "b", 40.0, 1, 40.0, 40.0, 40.0), ("west", "a", 30.0, 1, 30.0, 30.0, 30.0)]
    assert values(primitive.filter_equal(df, "region", "west")) == [("west", "a", 30)]
    with pytest.raises(E.EmptyGroupBy):
        primitive.group_by(df, [], [("amount", "sum")])
    with pytest.raises(E.InvalidAggregateType):
        primitive.group_by(df, ["region"], [("category", "sum")])
