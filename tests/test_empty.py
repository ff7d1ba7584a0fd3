"""Every query of the engine and the jobs on tables without a row: no error, and no row but of totals."""

import os

import pytest

import __spark_entry__

from .test_catalogue import FOLDER, TABLES, names

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
TOTALS = {"build_counts", "louvain_invariants", "ner_summary", "evidence_answer", "eval_metrics"}


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("nothing"))
    for t in TABLES:
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return at


@pytest.mark.parametrize("name", [*names(), "job1_token_index", "job2_ingest_segments"])
def test_query(spark, nothing, name):
    assert __spark_entry__.queries()[name](spark, nothing).count() == (name in TOTALS)
