"""Every query of the catalogue against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import as_rows, sql_rows

from quillspark import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    rows = catalog.queries()[name](spark, SMALL).toPandas()
    if name in catalog.oracle_sql():
        wanted = sql_rows(catalog.oracle_sql()[name], SMALL)
        assert sorted(rows.columns) == sorted(wanted.columns)
        assert as_rows(rows) == as_rows(wanted)
    else:
        assert len(rows)
