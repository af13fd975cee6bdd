import math

import duckdb
import numpy as np
import pytest

from tessera.functions import kernels
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{SF}/events.parquet')")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, 0 if x is None else x) for x in r])


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = ordered(tuple(r[n] for n in names) for r in df.collect())
    assert got
    if sql := catalog.oracle_sql().get(name):
        want = ordered(db.sql(f"select {', '.join(f'\"{n}\"' for n in names)} from ({sql})").fetchall())
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert all(map(same, g, w)), (names, g, w)


def test_multi_periodogram_direct_half_frequencies(spark, tmp_path):
    """9 and 41 points of both bands put 22.5 and 184.5 frequencies in a grid."""
    sizes = [(n, span) for n in (9, 10, 41) for span in (16, 20, 29)]
    rng, rows = np.random.default_rng(0), []
    for user, (n, span) in enumerate(sizes):
        at = np.r_[0, np.sort(rng.random(n - 2)), 1] * span * 86_400_000_000
        rows += [(1000 * user + i, int(x), user, ("click", "view")[i % 2], round(float(rng.random()) * 100, 2)) for i, x in enumerate(at)]
    db = duckdb.connect()
    db.execute("create table made (event_id bigint, us bigint, user_id bigint, event_type varchar, value double)")
    db.executemany("insert into made values (?, ?, ?, ?, ?)", rows)
    db.execute(f"copy (select event_id, timestamp '2024-01-01' + to_microseconds(us) ts, user_id, event_type, value from made) to '{tmp_path}/events.parquet'")
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = ordered(map(tuple, catalog.multi_periodogram_direct(spark, str(tmp_path)).collect()))
    want = ordered(db.sql(catalog.oracle_sql()["multi_periodogram_direct"]).fetchall())
    assert len(got) == len(want) == len(sizes)
    for g, w in zip(got, want):
        assert all(map(same, g, w)), (g, w)


def test_nearest():
    assert [kernels.nearest(x) for x in (0.0, 0.49999999999999994, 0.5, 1.5, 2.5, 184.49999999999997, 184.5, -0.25)] == [0, 0, 1, 2, 3, 184, 185, 0]
