"""SQL twins of the operators on the smallest tables."""

import duckdb
import pytest

from pagelake.llm.oracle import oracle
from pagelake.llm.queries import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle()))
def test_operator_equals_its_twin(spark, name):
    con = duckdb.connect()
    for name_of in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name_of} AS SELECT * FROM '{SF_DIR}/{name_of}.parquet'")
    cursor = con.execute(oracle()[name])
    df = queries()[name](spark, SF_DIR)
    assert [d[0] for d in cursor.description] == df.columns
    assert sorted(cursor.fetchall()) == sorted(tuple(r) for r in df.collect())
