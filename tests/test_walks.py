"""Walks against a plain loop, on chains longer than any fixed bound, forks and cycles."""

import random

import pytest

from quern.operators import relations


def brute(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for r in set(after) - {b for _, b in edges}:
        seen, now = [], r
        while now is not None and now not in seen:
            seen.append(now)
            now = next(iter(after[now])) if len(after.get(now, ())) == 1 else None
        out[r] = (seen[-1], len(seen) - 1)
    return out


R = random.Random(3)
CHAIN = [(i, i + 1) for i in range(70)]
CASES = {
    "chain": CHAIN + [(500, 60), (501, 502), (501, 503)],
    "fork": CHAIN[:20] + [(20, 90), (20, 91)],
    "cycle": CHAIN[:30] + [(30, 19), (600, 24), (700, 700), (701, 700), (800, 801)],
    "even cycle": CHAIN[:40] + [(40, 9)] + [(1000 + i, 1000 + i // 2) for i in range(1, 40)],
    "random": [(i, R.randrange(300)) for i in range(400)],
}


@pytest.mark.parametrize("name", CASES)
def test_whole_walks(spark, name):
    got = relations.walks(spark.createDataFrame(CASES[name], "src long, dst long")).collect()
    assert {r.root: (r["last"], r.steps) for r in got} == brute(CASES[name])
    assert len(got) == len(brute(CASES[name]))


def test_roots_are_not_walked(spark, monkeypatch):
    """Rows joined again and again are those something leads to; repeated edges and null ends are no second successor or node."""
    seen, whole = [], relations._doubled
    monkeypatch.setattr(relations, "_doubled", lambda at: seen.append(at.count()) or whole(at))
    edges = [(1000 + i, i % 5) for i in range(500)] + CHAIN[:9] * 2 + [(2000, None), (2001, None), (2001, 3), (None, 7)]
    got = {r.root: (r["last"], r.steps) for r in relations.walks(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1000 + i: (9, 10 - i % 5) for i in range(500)} | {2000: (2000, 0), 2001: (2001, 0)}
    assert seen and max(seen) <= 9


def test_runs_hold_no_table(spark):
    rows = [("a", i) for i in (3, 1, 2, 2, 7, 9, 10, None, None)] + [("b", None), (None, 4), (None, 5), ("c", 2**63 - 1), ("c", -(2**63))]
    df = relations.islands(spark.createDataFrame(rows, "g string, n long"), "g", "n")
    want = [("a", 1, 3, 3), ("a", 7, 7, 1), ("a", 9, 10, 2), ("a", None, None, 1), ("b", None, None, 1), (None, 4, 5, 2), ("c", 2**63 - 1, 2**63 - 1, 1), ("c", -(2**63), -(2**63), 1)]
    assert df.columns == ["g", "first", "last", "length"]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()
