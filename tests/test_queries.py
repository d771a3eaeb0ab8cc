"""Every query on the driver tables against its SQL."""

from __future__ import annotations

import pytest

from tests.against import TABLES, differing
from tessera.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    found = catalog.QUERIES[name](spark, TABLES)
    if name in catalog.ORACLE:
        assert not differing(found, catalog.ORACLE[name])
    else:
        found.collect()
