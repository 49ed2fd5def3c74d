import duckdb
import pytest

from quillon.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cursor.fetchall())


@pytest.mark.parametrize("name, columns", [
    ("op2_chat", "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars"),
    ("op4_quality_rules", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
    ("op6_packing", "doc_id piece start n_tokens bin_id bin_offset bin_tokens capacity"),
    ("op7_url_filter", "page_id host path rule verdict"),
])
def test_query_covers_its_whole_table(spark, name, columns):
    df = QUERIES[name](spark, SF)
    assert df.columns[: len(columns.split())] == columns.split()
    table = {"op2": "conversations", "op7": "pages"}.get(name[:3], "documents")
    key = df.columns[0]
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()} | ({-7} if name == "op2_chat" else set())
    assert {r[0] for r in df.select(key).collect()} == want
