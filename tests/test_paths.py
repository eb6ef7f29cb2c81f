"""Path searches on graphs that are long, or that have no end."""

import pytest

from pathloom.lang.errors import BindError
from pathloom.operators import paths as P
from pathloom.session import Session
from pathloom.sources.graph import PropertyGraph


def hops(spark, pairs, cost=1.0):
    return spark.createDataFrame([(a, b, i, cost, a) for i, (a, b) in enumerate(pairs)], "from long, to long, hop_id long, hop_cost double, hop long")


def test_a_long_chain(spark):
    """20,000 hops in steps by the logarithm."""
    pairs = spark.range(20_000).selectExpr("id as from", "id + 1 as to")
    seeds = spark.createDataFrame([(0,), (19_990,)], "root long")
    got = P.reachable(pairs, seeds, 1, None).groupBy("root").count().collect()
    assert {r["root"]: r["count"] for r in got} == {0: 20_000, 19_990: 10}


@pytest.mark.parametrize("low", [0, 1, 3])
def test_shortcuts_end_where_they_are_many(spark, monkeypatch, low):
    """A ring with chords and a tail: the same as by brute force, whatever number of shortcuts is allowed."""
    pairs = [(i, (i + 1) % 40) for i in range(40)] + [(i, (i * 7) % 40) for i in range(0, 40, 5)] + [(5, 100)] + [(100 + i, 101 + i) for i in range(60)]
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    want = set()
    for root in (0, 5, 130, 160):
        level = {root}
        for _ in range(low):
            level = set().union(*(after.get(x, set()) for x in level)) if level else set()
        seen, todo = set(level), list(level)
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        want |= {(root, x) for x in seen}
    seeds = spark.createDataFrame([(0,), (5,), (130,), (160,)], "root long")
    for patience, shortcuts in ((2, 4), (2, 1), (100, 4)):
        monkeypatch.setattr(P, "PATIENCE", patience)
        monkeypatch.setattr(P, "SHORTCUTS", shortcuts)
        got = P.reachable(hops(spark, pairs), seeds, low, None).collect()
        assert {(r.root, r.node) for r in got} == want and len(got) == len(want)


def test_walks_without_end_are_refused(spark):
    ring = hops(spark, [(0, 1), (1, 2), (2, 0)], 0.0)
    seeds = spark.createDataFrame([(0,)], "root long")
    with pytest.raises(BindError, match="costs nothing"):
        P.best_walks(ring, seeds, 1, None, 0, True)
    assert P.best_walks(ring, seeds, 1, None, 2, True).count() == 6


def test_match_numbers_are_one_a_match(spark):
    g = PropertyGraph("g").add_vertices("A", spark.range(100).repartition(5), "id", {"id": "k"})
    s = Session(spark).register(g)
    rows = s.execute("SELECT a.k AS k, MATCH_NUMBER(a) AS m, MATCH_NUMBER(b) AS n FROM MATCH (a:A), MATCH (b:A) WHERE a.k + 1 = b.k AND MATCH_NUMBER(b) > 7 ORDER BY m DESC").collect()
    numbers = [r.m for r in rows]
    assert all(r.m == r.n > 7 for r in rows) and numbers == sorted(set(numbers), reverse=True) and len(rows) > 50
