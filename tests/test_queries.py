"""Every registered query of the library against its DuckDB SQL."""

import pytest

from leadloom.plans import registry
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_oracle(spark, con, name):
    check(spark, con, registry.queries()[name], registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", ["ml_train", "ml_baseline", "ml_score_batch", "ml_calibrate"])
def test_models_give_rows(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    assert rows


def test_entry_runs(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).columns) == 7
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
