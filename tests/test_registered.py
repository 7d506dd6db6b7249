"""Registered queries against their SQL twins on the smallest tables.

All of them run with PAGELAKE_ALL=1; by default one of each kind does.
"""

import math
import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from pagelake.plans.catalog import all_queries
from pagelake.plans.oracle import oracle

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = (
    "fingerprint", "scoped_slides_user", "library_list", "extract_elements", "text_recall", "vector_recall_postfilter", "hybrid_filter_only",
    "duplicate_groups", "similar_slides", "suggest_versions", "match_versions_exact", "match_versions", "assign_versions", "parse_packages", "merge_ai_tags",
    "job_durations", "favorites_changed", "eval_recall_ndcg", "stream_job_state", "job_collapse", "job_latest", "hard_delete_cascade", "patch_slides",
    "file_dedup", "stream_dedup", "merge_ocr", "browse_pages_deep", "snapshot_merges",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(names)
    at = [names.index(n) for n in order]
    clean = lambda v: (None if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in at) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("PAGELAKE_ALL") else QUICK)
def test_query_equals_its_twin(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cursor.fetchall())


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(all_queries()) == set(oracle())
