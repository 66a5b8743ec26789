"""Every registered query of the core library against its SQL, and the driver's contract."""

import pytest

from quireloom import registry

NAMES = sorted(registry.queries())


def test_every_query_has_sql():
    assert set(NAMES) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(name, same):
    same(name, registry.queries()[name], registry.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(NAMES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
