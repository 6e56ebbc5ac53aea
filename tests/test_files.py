"""A listed table that is a folder: part files share their names with those of another table."""

import oracle
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("above", ["plain", "with space+50%", "data.parquet"])
def test_a_folder_is_one_table(spark, tmp_path, above):
    for table, n in (("documents", 70), ("labels", 30)):
        for part in range(3):
            at = tmp_path / above / f"{table}.parquet"
            at.mkdir(parents=True, exist_ok=True)
            oracle.duckdb.sql(f"COPY (SELECT i doc_id, 'a' AS text FROM range({n}) r(i) WHERE i % 3 = {part} AND i < {n}) TO '{at}/part-{part:04d}.parquet'")
    oracle.duckdb.sql(f"COPY (SELECT 1::BIGINT doc_id, 'a' AS text LIMIT 0) TO '{tmp_path / above}/documents.parquet/part-0003.parquet'")
    got = entry.queries()["io_list_files"](spark, str(tmp_path / above))
    con = oracle.duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path / above}/documents.parquet/*.parquet'")
    rel = con.sql(entry.oracle_sql()["io_list_files"])
    assert oracle.rows(got.columns, [tuple(r) for r in got.collect()]) == oracle.rows(rel.columns, rel.fetchall())


def test_an_empty_table_is_listed(spark, tmp_path):
    oracle.duckdb.sql(f"COPY (SELECT 1::BIGINT doc_id, 'a' AS text LIMIT 0) TO '{tmp_path}/documents.parquet'")
    assert [r.asDict() for r in entry.queries()["io_list_files"](spark, str(tmp_path)).collect()] == [{"file": "documents.parquet", "listed": True, "n_rows": 0}]
