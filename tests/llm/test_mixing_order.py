"""op2 against its SQL, row by row, with documents ranked in many salts."""

import duckdb
import pytest

from rallyloom.llm import mixing
from rallyloom.llm.queries import OP2_SQL


@pytest.mark.parametrize("rank_rows", [10_000, 40, 3])
def test_rows_equal_sql_at_any_number_of_salts(spark, tmp_path, rank_rows):
    rows = [(i, " ".join(["w"] * (3 + i % 2)), f"s{i % 3}") for i in range(400)] + [(None, "w w w", "s0")] * 2 + [(5, "w w w", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        known = duck.execute(f"SELECT doc_id, size, source_size, taken FROM ({OP2_SQL})").fetchall()
    got = [(r.doc_id, r.size, r.source_size, r.taken) for r in mixing.mix_documents(docs, params=mixing.MixParams(rank_rows=rank_rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, known))
