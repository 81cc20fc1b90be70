"""Every query of the core against its SQL, or for rows where there is none."""

import pytest

from stratalog.plans import catalog
from tests.compare import same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        same(df, duck, SQL[name])
    else:
        rows = df.collect()
        assert rows and not any(all(v is None for v in r) for r in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
