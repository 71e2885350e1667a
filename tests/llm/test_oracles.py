"""Queries with SQL against it, the others for whole and steady results, on the small tables."""

from __future__ import annotations

import pytest

from tessera.llm import queries
from tests.conftest import SMALL, agrees


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    agrees(spark, SMALL, queries.QUERIES[name], queries.ORACLES[name])


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
