"""The newer operators' queries side by side with DuckDB."""

import duckdb
import pytest

from kairograph.llm import queries as q

NAMES = ["op11_phrases", "op12_source_divergence", "op13_exact_dedup"]


@pytest.mark.parametrize("name", [n for n in NAMES if n in q.queries()])
def test_twin(spark, data, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got, want = q.queries()[name](spark, data), db.sql(q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(db.sql(f"SELECT {columns} FROM want").fetchall())
