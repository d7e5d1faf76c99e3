"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

from crosswind.plans import ORACLES, QUERIES
from tests.oracle import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# Queries that need more names than the smallest tables hold give no rows there.
MAY_BE_EMPTY = {"s11_panel_quality", "r03_successive_halving", "l09_retired_signatures", "l11_memory_feed", "b31_staggered_nav"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    verdict, rows, _, _ = check(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    if verdict == "EMPTY" and name in MAY_BE_EMPTY:
        return
    assert verdict in ("ok", "rows"), verdict


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
