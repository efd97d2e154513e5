"""Every query with SQL gives the rows of that SQL; the others give rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quadrille import plans

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


def _plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(_plain, x))
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple(map(_plain, x.values()))
    if isinstance(x, (float, np.floating)):
        return "nan" if math.isnan(x) else round(float(x), 9) + 0.0
    if x is None or isinstance(x, (bool, int)):
        return x
    return int(x) if isinstance(x, np.integer) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
