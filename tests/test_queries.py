import glob
import os

import duckdb
import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from check_oracles import compare
from hazeflow.schema import FEATURE_COLS

# Model fits: covered by tests/test_ml.py with small settings.
SLOW = {"rf_train_eval", "gbt_train_eval", "mlp_train_eval", "rf_tune", "gbt_tune", "tree_forest_eval", "tree_boosted_eval"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SMOKE_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_entry(spark):
    df = entry(spark)
    assert df.columns == FEATURE_COLS and df.count() > 0


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(set(queries()) - SLOW))
def test_query_equals_its_twin(spark, con, name):
    ok, message, _ = compare(spark, SMOKE_DIR, name, con)
    assert ok, message
