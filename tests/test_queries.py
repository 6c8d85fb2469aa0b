from __future__ import annotations

import pytest

from lemmaweave import queries as Q

from .conftest import SF, same

@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_against_sql(spark, duck, name):
    assert same(Q.queries()[name](spark, SF), duck.sql(Q.oracle_sql()[name]))


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(Q.queries()) == len(Q.oracle_sql())
