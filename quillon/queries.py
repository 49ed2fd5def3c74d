"""Queries on the test tables, each through a real dataset, and the SQL that each must equal."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .operators import lifecycle, primitive, rows
from .operators.dataset import Dataset
from .plans.requests import Aggregate, Compare, Filter, GroupByRequest, RowLookupRequest, ScanRequest, VectorSearchRequest
from .plans.schema import ROW_ID
from .sources import rowgroups
from .sources.ingest import conform, logical, schema_of
from .sources.shared import fresh_root
from .streaming import committing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_LOADED: dict[tuple, Dataset] = {}
DIMENSIONS = 64


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = logical(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    return df.withColumnRenamed("embedding", "vector") if table == "embeddings" else df


def dataset_of(spark: SparkSession, df: DataFrame, batches: list[DataFrame]) -> Dataset:
    out = Dataset.create(spark, fresh_root(spark), schema_of(df, {"vector": DIMENSIONS}))
    for batch in batches:
        with out.begin() as txn:
            txn.insert(conform(batch, out.schema))
    return out


def load(spark: SparkSession, sf_dir: str, table: str) -> Dataset:
    """A dataset of a whole table in one commit, kept for all queries that only read it."""
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _LOADED:
        df = source(spark, sf_dir, table)
        _LOADED[key] = dataset_of(spark, df, [df])
    return _LOADED[key]


#: Rows of a range that a load sorts, about.
RANGE_ROWS = 50_000


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """`df` sorted over range partitions, as many as its rows call for, so that row ids follow the keys."""
    return df.repartitionByRange(-(-df.count() // RANGE_ROWS) or 1, *keys).sortWithinPartitions(*keys)


def ordered(spark: SparkSession, sf_dir: str, table: str, *keys: str) -> Dataset:
    df = source(spark, sf_dir, table)
    return dataset_of(spark, df, [in_order(df, *keys)])


def sliced(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders in three commits by key: below 5,000, below 10,000, the rest."""
    key = (spark.sparkContext.applicationId, sf_dir, "sliced")
    if key not in _LOADED:
        df = source(spark, sf_dir, "orders")
        parts = ["o_orderkey < 5000", "o_orderkey >= 5000 AND o_orderkey < 10000", "o_orderkey >= 10000"]
        _LOADED[key] = dataset_of(spark, df, [df.where(p).coalesce(1) for p in parts])
    return _LOADED[key]


def odd_orders(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders with nulls, NaN, booleans and unsigned numbers."""
    key = (spark.sparkContext.applicationId, sf_dir, "odd")
    if key not in _LOADED:
        df = source(spark, sf_dir, "orders").select(
            "o_orderkey",
            F.expr("nullif(o_orderstatus, 'F')").alias("status"),
            F.expr("CASE WHEN o_orderkey % 7 = 0 THEN double('NaN') WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END").alias("price"),
            F.expr("CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END").alias("flag"),
            F.expr("cast(o_custkey as decimal(20, 0))").alias("customer"),
        )
        _LOADED[key] = dataset_of(spark, df, [df])
    return _LOADED[key]


ODD = """(SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS flag, o_custkey AS customer FROM orders)"""
CUSTOMER = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
NATION = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
C = Compare

# -- scans and projections ---------------------------------------------------------------------------------------------


@query("scan_all", CUSTOMER)
def _(spark, d):
    return load(spark, d, "customer").snapshot().scan_all()


@query("scan_predicate", CUSTOMER + " WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    return load(spark, d, "customer").snapshot().scan_predicate(C("c_mktsegment", "=", "BUILDING"))


@query("scan_typed", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity >= 40.0")
def _(spark, d):
    return load(spark, d, "lineitem").snapshot().scan(ScanRequest(("l_orderkey", "l_linenumber", "l_extendedprice"), C("l_quantity", ">=", 40.0)))


@query("scan_planned", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 5000")
def _(spark, d):
    return sliced(spark, d).snapshot().planned_scan(ScanRequest(("o_orderkey", "o_totalprice"), C("o_orderkey", ">=", 5000)))[1]


@query("scan_timestamps", "SELECT event_id, epoch_us(ts) AS ts, event_type FROM events WHERE value > 50.0")
def _(spark, d):
    return load(spark, d, "events").snapshot().scan(ScanRequest(("event_id", "ts", "event_type"), C("value", ">", 50.0)))


@query("scan_hidden", "SELECT n_name, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS _row_id, 1 AS _timestamps FROM nation")
def _(spark, d):
    found = ordered(spark, d, "nation", "n_nationkey").snapshot().scan_all(["n_name", "_row_id", "_timestamp"])
    return found.groupBy("n_name", "_row_id").agg(F.count_distinct("_timestamp").cast("int").alias("_timestamps"))


@query("project_all", NATION)
def _(spark, d):
    return load(spark, d, "nation").snapshot().scan(ScanRequest())


@query("project_order", "SELECT c_mktsegment, c_custkey FROM customer")
def _(spark, d):
    return load(spark, d, "customer").snapshot().scan(ScanRequest(("c_mktsegment", "c_custkey")))


@query("project_empty", "SELECT count(*) AS n FROM customer")
def _(spark, d):
    return load(spark, d, "customer").snapshot().scan(ScanRequest(())).agg(F.count("*").alias("n"))


@query("row_group_read", "SELECT count(*) AS n, CAST(round(sum(s_acctbal), 2) AS DOUBLE) AS balance FROM (SELECT s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier) WHERE r >= 4 AND r < 8")
def _(spark, d):
    root = fresh_root(spark)
    rowgroups.write_row_groups(source(spark, d, "supplier").coalesce(1).sortWithinPartitions("s_suppkey"), root, 2)
    return rowgroups.read_row_groups(spark, root, 2, 2, ["s_acctbal"]).agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


# -- filters -----------------------------------------------------------------------------------------------------------

_OPS = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def _filter_query(name: str, f: Filter, where: str, table: str | None = None) -> None:
    """A scan of keys by `f`, of the odd orders or of a whole table."""
    if table is None:
        QUERIES[name] = lambda spark, d: odd_orders(spark, d).snapshot().scan(ScanRequest(("o_orderkey",), f))
        ORACLE_SQL[name] = f"SELECT o_orderkey FROM {ODD} WHERE {where}"
    else:
        key, name_of = table
        QUERIES[name] = lambda spark, d: load(spark, d, name_of).snapshot().scan(ScanRequest((key,), f))
        ORACLE_SQL[name] = f"SELECT {key} FROM {name_of} WHERE {where}"


#: A price that occurs, so that = keeps a row.
SOME_PRICE = "(SELECT min(o_totalprice) FROM orders WHERE o_totalprice > 150000.0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0)"


def _some_price(spark: SparkSession, d: str) -> float:
    return spark.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 150000.0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0").agg(F.min("o_totalprice")).first()[0]


def _price_query(name: str, op: str, where: str) -> None:
    QUERIES[name] = lambda spark, d: odd_orders(spark, d).snapshot().scan(ScanRequest(("o_orderkey",), C("price", op, _some_price(spark, d))))
    ORACLE_SQL[name] = f"SELECT o_orderkey FROM {ODD} WHERE {where}"


def _count_query(name: str, f: Filter, where: str) -> None:
    """How many rows a filter keeps, beside how many there are; for filters that may keep none."""

    def made(spark, d):
        view = odd_orders(spark, d).snapshot()
        parts = [view.scan(ScanRequest(("o_orderkey",), g)).agg(F.lit(what).alias("what"), F.count("*").alias("n")) for what, g in (("kept", f), ("all", None))]
        return parts[0].unionByName(parts[1])

    QUERIES[name] = made
    ORACLE_SQL[name] = f"SELECT 'kept' AS what, count(*) FILTER (WHERE {where}) AS n FROM {ODD} UNION ALL SELECT 'all', count(*) FROM {ODD}"


for _key, _op in _OPS.items():
    _plain = f"price {_op.replace('!=', '<>')} {SOME_PRICE}"
    _filter_query(f"filter_{_key}", C("o_custkey", _op, 700), f"o_custkey {_op.replace('!=', '<>')} 700", ("o_orderkey", "orders"))
    _filter_query(f"filter_{_key}_text", C("status", _op, "P"), f"status {_op.replace('!=', '<>')} 'P'")
    _price_query(f"filter_{_key}_float", _op, f"price IS NOT NULL AND (isnan(price) OR {_plain})" if _op == "!=" else f"NOT isnan(price) AND {_plain}")
    _count_query(f"filter_{_key}_nan", C("price", _op, math.nan), "price IS NOT NULL" if _op == "!=" else "false")
    _filter_query(f"filter_{_key}_unsigned", C("customer", _op, 700), f"customer {_op.replace('!=', '<>')} 700")
_filter_query("filter_bool", C("flag", "=", True), "flag")
_filter_query("filter_bool_ne", C("flag", "!=", True), "NOT flag")
_filter_query("filter_and", C("status", "=", "O") & C("flag", "=", True), "status = 'O' AND flag")
_filter_query("filter_or", C("status", "=", "O") | C("flag", "=", True), "status = 'O' OR flag")
_filter_query("filter_not", ~(C("status", "=", "O") & C("flag", "=", True)), "NOT (status = 'O' AND flag)")
_filter_query("filter_not_lt_nan", ~C("price", "<", 150000.0), "price IS NOT NULL AND (isnan(price) OR price >= 150000.0)")


@query("filter_eq_str", "SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#11'")
def _(spark, d):
    return primitive.filter_equal(load(spark, d, "part").snapshot().scan_all(["p_partkey", "p_brand"]), "p_brand", "Brand#11")


for _key, _op in {k: v for k, v in _OPS.items() if k != "ne"}.items():
    QUERIES[f"pred_{_key}"] = lambda spark, d, op=_op: load(spark, d, "orders").snapshot().scan_predicate(C("o_totalprice", op, _some_price(spark, d)), ["o_orderkey", "o_totalprice"])
    ORACLE_SQL[f"pred_{_key}"] = f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice {_op} {SOME_PRICE}"


@query("pred_and_or", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'O' AND o_custkey > 500) OR o_custkey <= 20")
def _(spark, d):
    return load(spark, d, "orders").snapshot().scan_predicate((C("o_orderstatus", "=", "O") & C("o_custkey", ">", 500)) | C("o_custkey", "<=", 20), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("matching_row_ids", "SELECT r AS row_id FROM (SELECT *, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS r FROM orders) WHERE o_totalprice > 200000.0")
def _(spark, d):
    return ordered(spark, d, "orders", "o_orderkey").snapshot().matching_row_ids(C("o_totalprice", ">", 200000.0))


@query("live_set", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000.0")
def _(spark, d):
    view = load(spark, d, "orders").snapshot()
    first, again = view.live_set(C("o_totalprice", ">", 200000.0)), view.live_set(C("o_totalprice", ">", 200000.0))
    return first.agg(F.count("*").alias("n")) if first is again else first


# -- grouping ----------------------------------------------------------------------------------------------------------


def _agg(table: str, keys, aggregates, f: Filter | None = None, loader=load):
    return lambda spark, d: (loader(spark, d, table) if loader is load else loader(spark, d)).snapshot().group_by(GroupByRequest(keys, tuple(Aggregate(*a) for a in aggregates), f))


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "group_by_typed",
    "SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 4) AS mean FROM lineitem WHERE l_quantity >= 40.0 GROUP BY 1, 2",
)
def group_by_typed(spark, d):
    made = _agg("lineitem", ("l_returnflag", "l_linestatus"), [("l_extendedprice", "count", "n"), ("l_extendedprice", "sum", "total"), ("l_extendedprice", "avg", "mean")], C("l_quantity", ">=", 40.0))
    return _rounded(made(spark, d), total=2, mean=4)


@query("agg_count", f"SELECT status, count(price) AS n, count(flag) AS flags FROM {ODD} GROUP BY status")
def _(spark, d):
    return _agg("", ("status",), [("price", "count", "n"), ("flag", "count", "flags")], loader=odd_orders)(spark, d)


@query("agg_sum_int", "SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def _(spark, d):
    return _agg("orders", ("o_orderstatus",), [("o_custkey", "sum", "total")])(spark, d)


@query("agg_sum_float", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(spark, d):
    return _rounded(_agg("orders", ("o_orderpriority",), [("o_totalprice", "sum", "total")])(spark, d), total=2)


@query("agg_min", f"SELECT status, min(CASE WHEN NOT isnan(price) THEN price END) AS low, min(o_orderkey) AS first FROM {ODD} GROUP BY status")
def _(spark, d):
    return _agg("", ("status",), [("price", "min", "low"), ("o_orderkey", "min", "first")], loader=odd_orders)(spark, d)


@query("agg_max", f"SELECT status, max(CASE WHEN NOT isnan(price) THEN price END) AS high, max(o_orderkey) AS last FROM {ODD} GROUP BY status")
def _(spark, d):
    return _agg("", ("status",), [("price", "max", "high"), ("o_orderkey", "max", "last")], loader=odd_orders)(spark, d)


@query("agg_avg", "SELECT event_type, round(avg(value), 6) AS mean, round(avg(user_id), 6) AS users FROM events GROUP BY 1")
def _(spark, d):
    return _rounded(_agg("events", ("event_type",), [("value", "avg", "mean"), ("user_id", "avg", "users")])(spark, d), mean=6, users=6)


@query("group_multi_key", "SELECT o_orderstatus, o_orderpriority, count(o_orderkey) AS n, CAST(sum(o_custkey) AS BIGINT) AS customers, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1, 2")
def _(spark, d):
    return _agg("orders", ("o_orderstatus", "o_orderpriority"), [("o_orderkey", "count", "n"), ("o_custkey", "sum", "customers"), ("o_totalprice", "min", "low"), ("o_totalprice", "max", "high")])(spark, d)


@query("group_keys_only", "SELECT DISTINCT lang, source FROM documents")
def _(spark, d):
    return _agg("documents", ("lang", "source"), [])(spark, d)


@query("group_null_bool_key", f"SELECT flag, count(o_orderkey) AS n FROM {ODD} GROUP BY flag")
def _(spark, d):
    return _agg("", ("flag",), [("o_orderkey", "count", "n")], loader=odd_orders)(spark, d)


@query("group_float_key", "SELECT l_discount, count(l_orderkey) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return _agg("lineitem", ("l_discount",), [("l_orderkey", "count", "n")])(spark, d)


@query("group_unsigned_key", "SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return _agg("", ("customer",), [("o_orderkey", "count", "n")], loader=odd_orders)(spark, d).withColumn("customer", F.col("customer").cast("long"))


@query("group_high_cardinality", "SELECT l_orderkey, count(l_partkey) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def _(spark, d):
    return _rounded(_agg("lineitem", ("l_orderkey",), [("l_partkey", "count", "n"), ("l_extendedprice", "sum", "total")])(spark, d), total=2)


@query("group_planned", "SELECT o_orderpriority, count(o_orderkey) AS n FROM orders WHERE o_orderkey < 5000 GROUP BY 1")
def _(spark, d):
    return sliced(spark, d).snapshot().planned_group_by(GroupByRequest(("o_orderpriority",), (Aggregate("o_orderkey", "count", "n"),), C("o_orderkey", "<", 5000)))[1]


@query("group_legacy", "SELECT c_mktsegment, count(c_custkey) AS c_custkey_count, CAST(sum(c_nationkey) AS DOUBLE) AS c_nationkey_sum, min(c_acctbal) AS c_acctbal_min, max(c_acctbal) AS c_acctbal_max, round(avg(c_acctbal), 6) AS c_acctbal_avg FROM customer GROUP BY 1")
def _(spark, d):
    df = load(spark, d, "customer").snapshot().scan_all()
    return _rounded(primitive.group_by(df, ["c_mktsegment"], [("c_custkey", "count"), ("c_nationkey", "sum"), ("c_acctbal", "min"), ("c_acctbal", "max"), ("c_acctbal", "avg")]), c_acctbal_avg=6)


# -- transactions ------------------------------------------------------------------------------------------------------



def _nation_rows(dataset: Dataset, *table: tuple) -> DataFrame:
    return dataset.spark.createDataFrame(list(table), dataset.schema.spark())


@query("txn_insert", NATION + " UNION ALL SELECT 100, 'ATLANTIS', 0")
def _(spark, d):
    ds = ordered(spark, d, "nation", "n_nationkey")
    with ds.begin() as txn:
        txn.insert(_nation_rows(ds, (100, "ATLANTIS", 0)))
    return ds.snapshot().scan(ScanRequest())


@query("txn_delete", NATION + " WHERE n_nationkey NOT IN (3, 7)")
def _(spark, d):
    ds = ordered(spark, d, "nation", "n_nationkey")
    with ds.begin() as txn:
        txn.delete(3)
        txn.delete(7)
    return ds.snapshot().scan(ScanRequest())


@query("txn_update", NATION + " WHERE n_nationkey <> 4 UNION ALL SELECT 4, 'RENAMED', 2")
def _(spark, d):
    ds = ordered(spark, d, "nation", "n_nationkey")
    with ds.begin() as txn:
        txn.update(4, _nation_rows(ds, (4, "RENAMED", 2)))
    return ds.snapshot().scan(ScanRequest())


@query("txn_conflict", "SELECT 'conflict' AS outcome, 5 AS row_id")
def _(spark, d):
    from .errors import Conflict

    ds = ordered(spark, d, "nation", "n_nationkey")
    one, two = ds.begin(), ds.begin()
    one.delete(5)
    two.delete(5)
    one.commit()
    try:
        two.commit()
        found = [("committed", 5)]
    except Conflict as error:
        found = [("conflict", i) for i in error.contested_row_ids]
    return spark.createDataFrame(found, "outcome string, row_id int")


@query("overlay_scan", NATION + " WHERE n_nationkey NOT IN (1, 2) UNION ALL SELECT 2, 'STAGED', 9 UNION ALL SELECT 100, 'ATLANTIS', 0")
def _(spark, d):
    txn = _overlay(spark, d)
    return txn.scan(ScanRequest())


def _overlay(spark, d):
    ds = ordered(spark, d, "nation", "n_nationkey")
    txn = ds.begin()
    txn.insert(_nation_rows(ds, (100, "ATLANTIS", 0)))
    txn.delete(1)
    txn.update(2, _nation_rows(ds, (2, "STAGED", 9)))
    return txn


@query("overlay_group", "SELECT n_regionkey, count(n_name) AS n FROM (" + NATION + " WHERE n_nationkey NOT IN (1, 2) UNION ALL SELECT 2, 'STAGED', 9 UNION ALL SELECT 100, 'ATLANTIS', 0) GROUP BY 1")
def _(spark, d):
    return _overlay(spark, d).group_by(GroupByRequest(("n_regionkey",), (Aggregate("n_name", "count", "n"),)))


def _outcomes(spark, found) -> DataFrame:
    return spark.createDataFrame([(x.row_id, x.outcome, x.row[0] if x.row else None) for x in found], "row_id int, outcome string, n_name string")


@query("overlay_lookup", "SELECT 0 AS row_id, 'live' AS outcome, (SELECT n_name FROM nation WHERE n_nationkey = 0) AS n_name UNION ALL SELECT 1, 'tombstoned', NULL UNION ALL SELECT 2, 'live', 'STAGED' UNION ALL SELECT 99, 'not_found', NULL")
def _(spark, d):
    txn = _overlay(spark, d)
    return _outcomes(spark, [txn.lookup(RowLookupRequest(i, ("n_name",))) for i in (0, 1, 2, 99)])


@query("row_lookup", "SELECT 6 AS row_id, 'tombstoned' AS outcome, NULL::VARCHAR AS n_name UNION ALL SELECT 24, 'live', (SELECT n_name FROM nation WHERE n_nationkey = 24) UNION ALL SELECT 25, 'not_found', NULL")
def _(spark, d):
    ds = ordered(spark, d, "nation", "n_nationkey")
    with ds.begin() as txn:
        txn.delete(6)
    view = ds.snapshot()
    return _outcomes(spark, [view.lookup(i, ("n_name",)) for i in (6, 24, 25)])


@query("tombstone_antijoin", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT o_totalprice > 250000.0")
def _(spark, d):
    ds = ordered(spark, d, "orders", "o_orderkey")
    with ds.begin() as txn:
        txn.delete_where(C("o_totalprice", ">", 250000.0))
    return ds.snapshot().scan(ScanRequest(("o_orderkey", "o_custkey")))


@query("snapshot_isolation", NATION)
def _(spark, d):
    ds = ordered(spark, d, "nation", "n_nationkey")
    before = ds.snapshot()
    with ds.begin() as txn:
        txn.delete(0)
        txn.insert(_nation_rows(ds, (100, "ATLANTIS", 0)))
    _HELD.append(before)
    return before.scan(ScanRequest())


_HELD: list = []  # snapshots whose frames are still to be read


@query("commit_visibility", "SELECT 1 AS step, count(*) AS n FROM nation UNION ALL SELECT 2, count(*) FROM nation UNION ALL SELECT 3, count(*) + 1 FROM nation")
def _(spark, d):
    ds = ordered(spark, d, "nation", "n_nationkey")
    count = lambda: ds.snapshot().scan(ScanRequest(())).count()
    seen = [(1, count())]
    txn = ds.begin()
    txn.insert(_nation_rows(ds, (100, "ATLANTIS", 0)))
    seen.append((2, count()))
    txn.commit()
    return spark.createDataFrame([*seen, (3, count())], "step int, n long")


@query("row_ids_contiguous", "SELECT count(*) AS n, 0::BIGINT AS first, count(*) - 1 AS last, count(*) AS ids FROM lineitem")
def _(spark, d):
    ids = load(spark, d, "lineitem").snapshot().scan_all([ROW_ID])
    return ids.agg(F.count("*").alias("n"), F.min(ROW_ID).alias("first"), F.max(ROW_ID).alias("last"), F.count_distinct(ROW_ID).alias("ids"))


@query("stream_commit", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    df = source(spark, d, "events")
    ds = Dataset.create(spark, fresh_root(spark), schema_of(df))
    raw = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
    committing(ds, logical(raw)).trigger(availableNow=True).option("checkpointLocation", fresh_root(spark)).start().awaitTermination()
    return ds.snapshot().group_by(GroupByRequest(("event_type",), (Aggregate("event_id", "count", "n"),)))


# -- files, statistics, explain ----------------------------------------------------------------------------------------

_SLICE = "CASE WHEN o_orderkey < 5000 THEN 0 WHEN o_orderkey < 10000 THEN 1 ELSE 2 END"


@query("prune_files", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 12000 AND o_totalprice <> 1.0")
def _(spark, d):
    return sliced(spark, d).snapshot().scan(ScanRequest(("o_orderkey",), C("o_orderkey", ">=", 12000) & C("o_totalprice", "!=", 1.0)))


@query("explain_files", f"SELECT CAST(3 - count(*) FILTER (scanned) AS BIGINT) AS skipped, count(*) FILTER (scanned) AS scanned FROM (SELECT {_SLICE} AS s, max(o_orderkey) >= 12000 AS scanned FROM orders GROUP BY 1)")
def _(spark, d):
    plan = sliced(spark, d).snapshot().explain(C("o_orderkey", ">=", 12000))
    return plan.agg(F.lit(3) - F.count_if("scanned"), F.count_if("scanned")).toDF("skipped", "scanned") if plan.count() == 3 else plan


@query("explain_plan", "SELECT unnest(range(6)) AS step, unnest(['manifest_snapshot_source', 'zone_map_pruning', 'tombstone_filter', 'row_filter', 'column_projection', 'materialize']) AS operator")
def _(spark, d):
    plan = sliced(spark, d).snapshot().explain_scan(ScanRequest(("o_orderkey",), C("o_orderkey", ">=", 12000)))
    return spark.createDataFrame(list(enumerate(plan.physical)), "step long, operator string")


@query("zone_maps", f"SELECT {_SLICE} AS slice, min(o_orderkey) AS low, max(o_orderkey) AS high, min(o_orderpriority) AS first, max(o_orderpriority) AS last FROM orders GROUP BY 1")
def _(spark, d):
    made = [(i, *f.stats["o_orderkey"], *f.stats["o_orderpriority"]) for i, f in enumerate(f for f in sliced(spark, d).snapshot().manifest.files if f.row_count)]
    return spark.createDataFrame(made, "slice int, low long, high long, first string, last string")


@query("file_info", f"SELECT n AS row_count, CAST(sum(n) OVER (ORDER BY s) - n AS BIGINT) AS first_row_id, CAST(sum(n) OVER (ORDER BY s) - 1 AS BIGINT) AS last_row_id FROM (SELECT {_SLICE} AS s, count(*) AS n FROM orders GROUP BY 1)")
def _(spark, d):
    return sliced(spark, d).snapshot().files().where("row_count > 0").select("row_count", "first_row_id", "last_row_id")


@query("inventory", "SELECT 4::BIGINT AS manifest_object_count, 3::BIGINT AS reachable_data_file_count, 0::BIGINT AS orphan_candidate_count, 0::BIGINT AS tombstone_count, count(*) AS physical_row_count FROM orders")
def _(spark, d):
    return lifecycle.inventory_frame(sliced(spark, d)).select("manifest_object_count", "reachable_data_file_count", "orphan_candidate_count", "tombstone_count", "physical_row_count")


# -- vectors -----------------------------------------------------------------------------------------------------------

QUERY_VECTOR = tuple(round(math.sin(i + 1) / 8, 6) for i in range(DIMENSIONS))
_LIST = "[" + ", ".join(f"{x!r}::DOUBLE" for x in QUERY_VECTOR) + "]"


def _knn_sql(where: str, k: int, columns: str = "", distance: str | None = None) -> str:
    d = distance or f"list_sum(list_transform(list_zip(embedding, {_LIST}), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))"
    return f"SELECT row_id, round(distance, 9) AS distance{columns} FROM (SELECT *, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS row_id, {d} AS distance FROM embeddings) WHERE {where} ORDER BY distance, row_id LIMIT {k}"


def _embeddings(spark, d) -> Dataset:
    key = (spark.sparkContext.applicationId, d, "embeddings by id")
    if key not in _LOADED:
        _LOADED[key] = ordered(spark, d, "embeddings", "vec_id")
    return _LOADED[key]


def _knn(k: int, f: Filter | None = None, hydrate=False):
    return lambda spark, d: _rounded(_embeddings(spark, d).snapshot().vector_search(VectorSearchRequest(QUERY_VECTOR, k, filter=f, hydrate=hydrate)), distance=9)


QUERIES["knn_exact"], ORACLE_SQL["knn_exact"] = _knn(10), _knn_sql("true", 10)
QUERIES["knn_typed"], ORACLE_SQL["knn_typed"] = _knn(50), _knn_sql("true", 50)
QUERIES["knn_filtered"], ORACLE_SQL["knn_filtered"] = _knn(10, C("label", "=", 3)), _knn_sql("label = 3", 10)
QUERIES["knn_hydrated"], ORACLE_SQL["knn_hydrated"] = _knn(10, C("label", "<", 5), ("vec_id", "label")), _knn_sql("label < 5", 10, ", vec_id, CAST(label AS BIGINT) AS label")


@query("knn_legacy", _knn_sql("label >= 2", 12))
def _(spark, d):
    view = _embeddings(spark, d).snapshot()
    live = view.live_set(C("label", ">=", 2)).withColumnRenamed("row_id", ROW_ID)
    return _rounded(rows.nearest(view.frame(ids=True).join(live, ROW_ID, "left_semi"), QUERY_VECTOR, 12, None), distance=9)


@query("knn_planned", _knn_sql("vec_id < 200", 10))
def _(spark, d):
    return _rounded(_embeddings(spark, d).snapshot().planned_vector_search(VectorSearchRequest(QUERY_VECTOR, 10, filter=C("vec_id", "<", 200)))[1], distance=9)


@query("knn_null_vectors", _knn_sql("vec_id % 3 <> 0", 10))
def _(spark, d):
    df = source(spark, d, "embeddings").withColumn("vector", F.when(F.col("vec_id") % 3 != 0, F.col("vector")))
    ds = dataset_of(spark, df, [in_order(df, "vec_id")])
    _HELD.append(view := ds.snapshot())
    return _rounded(view.vector_search(VectorSearchRequest(QUERY_VECTOR, 10)), distance=9)


_DOT = f"list_sum(list_transform(list_zip(embedding, {_LIST}), lambda p: p[1]::DOUBLE * p[2]))"
_NORM = f"sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * {sum(x * x for x in QUERY_VECTOR) ** 0.5!r}::DOUBLE"


@query("dist_dot", _knn_sql("true", 10, distance=f"-{_DOT}"))
def _(spark, d):
    return _rounded(rows.nearest(_embeddings(spark, d).snapshot().frame(ids=True), QUERY_VECTOR, 10, None, vectors.dot_distance), distance=9)


@query("dist_cosine", _knn_sql("true", 10, distance=f"1 - {_DOT} / ({_NORM})"))
def _(spark, d):
    return _rounded(rows.nearest(_embeddings(spark, d).snapshot().frame(ids=True), QUERY_VECTOR, 10, None, vectors.cosine_distance), distance=9)


# -- lifecycle ---------------------------------------------------------------------------------------------------------


def _holed_parts(spark, d) -> Dataset:
    ds = ordered(spark, d, "part", "p_partkey")
    with ds.begin() as txn:
        txn.delete_where(C("p_size", "<=", 5))
    return ds


@query("compact_preserves_rows", "SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS _row_id, p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part QUALIFY p_size > 5")
def _(spark, d):
    ds = _holed_parts(spark, d)
    ds.compact()
    _HELD.append(view := ds.snapshot())
    return view.scan_all(["_row_id", "p_partkey", "p_name", "p_size"])


@query("row_id_runs", "SELECT min(r) AS first, max(r) AS last FROM (SELECT r, r - row_number() OVER (ORDER BY r) AS g FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS r, p_size FROM part) WHERE p_size > 5) GROUP BY g")
def _(spark, d):
    _HELD.append(view := _holed_parts(spark, d).snapshot())
    return rows.id_runs(view.scan_all([ROW_ID]))


@query("migrate_add_column", NATION.replace(" FROM", ", NULL::VARCHAR AS tag FROM") + " UNION ALL SELECT 100, 'ATLANTIS', 0, 'new'")
def _(spark, d):
    ds = ordered(spark, d, "nation", "n_nationkey")
    ds.migrate_add_nullable_column(("tag", "utf8"))
    with ds.begin() as txn:
        txn.insert(_nation_rows(ds, (100, "ATLANTIS", 0, "new")))
    return ds.snapshot().scan(ScanRequest())


@query("retention_plan", "SELECT unnest([0, 1]) AS version, 'eligible' AS state UNION ALL SELECT unnest([2, 3]), 'retained'")
def _(spark, d):
    ds = ordered(spark, d, "nation", "n_nationkey")
    for i in (0, 1):
        with ds.begin() as txn:
            txn.delete(i)
        del txn
    import gc

    gc.collect()
    plan = ds.retention_plan(2)
    return spark.createDataFrame([*((v, "eligible") for v in plan.eligible_versions), *((v, "retained") for v in plan.retained_versions)], "version int, state string")


@query("maintain", "SELECT count(*) AS n, 0::BIGINT AS tombstones, true AS bound_met FROM nation WHERE n_nationkey > 0")
def _(spark, d):
    ds = ordered(spark, d, "nation", "n_nationkey")
    with ds.begin() as txn:
        txn.delete(0)
    del txn
    report = ds.maintain(1, 0, 100, 100)
    return spark.createDataFrame([(report.inventory.physical_row_count, report.inventory.tombstone_count, report.storage_bound_met)], "n long, tombstones long, bound_met boolean")


from . import outcomes  # noqa: E402, F401 - registers its queries


def entry(spark: SparkSession) -> DataFrame:
    """A typed filtered grouping over lineitem, committed in two batches."""
    df = source(spark, "/root/testdata/sf0.001", "lineitem")
    ds = dataset_of(spark, df, [df.where("l_quantity < 25"), df.where("l_quantity >= 25")])
    _HELD.append(view := ds.snapshot())
    request = GroupByRequest(("l_returnflag", "l_linestatus"), (Aggregate("l_extendedprice", "count", "n"), Aggregate("l_extendedprice", "sum", "total"), Aggregate("l_extendedprice", "avg", "mean")), C("l_quantity", ">=", 40.0))
    return _rounded(view.group_by(request), total=2, mean=4)


__all__ = ["ORACLE_SQL", "QUERIES", "entry"]
