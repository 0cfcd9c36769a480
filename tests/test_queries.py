"""Every engine query against its DuckDB SQL, or for rows where there is none."""

import pytest

from sluice.plans import catalog
from tests.compare import same
from tests.conftest import SMALL

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLE:
        same(df, duck, ORACLE[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
