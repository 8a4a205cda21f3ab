"""Every registered query with an oracle equals DuckDB on the smallest tables; the others return rows."""

import pytest

from mnemosail import plans
from tests.conftest import DATA
from tests.oracle import connect, rows

FOLDER = f"{DATA}/sf0.001"
#: Their filters leave nothing in 87 messages.
MAY_BE_EMPTY = {"find_near_duplicates_removals", "fn_sequence_ratio", "join_dup_pairs_self", "fn_evidence_exact", "fn_evidence_ws_norm"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, duck):
    got = plans.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) or name in MAY_BE_EMPTY
    if name in plans.SQL:
        assert rows(got) == rows(duck.sql(plans.SQL[name]).df())


def test_oracles_have_queries():
    assert set(plans.SQL) <= set(plans.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
