"""Patterns and paths on small random graphs, against a matcher that tries everything."""

import random

import pytest

from pathloom.session import Session
from pathloom.sources.graph import PropertyGraph


def make(spark, seed, nodes=9, links=16):
    rng = random.Random(seed)
    people = [(i, rng.choice("xy"), rng.randrange(4)) for i in range(nodes)]
    cars = [(i, rng.choice("xy")) for i in range(3)]
    knows = [(rng.randrange(nodes), rng.randrange(nodes), rng.randrange(1, 6)) for _ in range(links)]
    owns = [(rng.randrange(nodes), rng.randrange(3)) for _ in range(5)]
    g = PropertyGraph("g")
    g.add_vertices("P", spark.createDataFrame(people, "k long, c string, n int"), "k")
    g.add_vertices("C", spark.createDataFrame(cars, "k long, c string"), "k")
    g.add_edges("knows", spark.createDataFrame(knows, "a long, b long, w long").coalesce(1), ("P", "a"), ("P", "b"), props=["w"])
    g.add_edges("owns", spark.createDataFrame(owns, "a long, b long").coalesce(1), ("P", "a"), ("C", "b"), props=[])
    vertices = [("P", k) for k, *_ in people] + [("C", k) for k, _ in cars]
    color = {("P", k): c for k, c, _ in people} | {("C", k): c for k, c in cars}
    edges = [("knows", ("P", a), ("P", b), w) for a, b, w in knows] + [("owns", ("P", a), ("C", b), None) for a, b in owns]
    return Session(spark).register(g), vertices, color, edges


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def walks(edges, root, most):
    """All walks of knows edges from a node: (end, edges)."""
    out, at = [(root, ())], [(root, ())]
    for _ in range(most):
        at = [(e[2], (*p, i)) for v, p in at for i, e in enumerate(edges) if e[0] == "knows" and e[1] == v]
        out += at
    return out


@pytest.mark.parametrize("seed", range(3))
def test_fixed_patterns(spark, seed):
    s, vs, color, es = make(spark, seed)
    got = rows(s.execute("SELECT a.k, b.k, LABEL(b) FROM MATCH (a)-[e]->(b) WHERE a.c = b.c"))
    assert got == sorted((a[1], b[1], b[0]) for _, a, b, _ in es if color[a] == color[b])
    got = rows(s.execute("SELECT a.k, b.k, c.k FROM MATCH (a:P)-[:knows]-(b:P)-[:owns]->(c)"))
    both = [(a, b) for t, a, b, _ in es if t == "knows"] + [(b, a) for t, a, b, _ in es if t == "knows" and a != b]
    assert got == sorted((a[1], b[1], c[1]) for a, b in both for t, x, c, _ in es if t == "owns" and x == b)
    got = rows(s.execute("SELECT a.k, b.k, e1.w, e2.w FROM MATCH (a:P)-[e1:knows]->(b)-[e2:knows]->(a)"))
    assert got == sorted((a[1], b[1], w, x) for t, a, b, w in es if t == "knows" for u, c, d, x in es if u == "knows" and c == b and d == a)
    got = rows(s.execute("SELECT a.k FROM MATCH (a)-[e:knows]->(a)"))
    assert got == sorted((a[1],) for t, a, b, _ in es if t == "knows" and a == b)
    got = rows(s.execute("SELECT COUNT(*) FROM MATCH (a), MATCH (b:C) WHERE a <> b"))
    assert got == [(len(vs) * 3 - 3,)]
    got = rows(s.execute("SELECT a.k FROM MATCH (a:P) WHERE NOT EXISTS (SELECT * FROM MATCH (a)-[:owns]->(c:C) WHERE c.c = a.c)"))
    assert got == sorted((a[1],) for a in vs if a[0] == "P" and not any(t == "owns" and x == a and color[c] == color[a] for t, x, c, _ in es))
    got = rows(s.execute("SELECT a.k, (SELECT SUM(e.w) + COUNT(*) FROM MATCH (a)-[e:knows]->(b) WHERE b.n >= a.n) AS t FROM MATCH (a:P) WHERE a.k < 3"))
    assert len(got) == 3


@pytest.mark.parametrize("seed", range(3))
def test_paths(spark, seed):
    s, vs, color, es = make(spark, seed, nodes=6, links=9)
    people = [v for v in vs if v[0] == "P"]
    found = {a: walks(es, a, 7) for a in people}

    def best(low, high, k, key):
        out = []
        for a in people:
            for b in people:
                own = sorted((key(p) for v, p in found[a] if v == b and low <= len(p) <= high))
                out += [(a[1], b[1], x) for x in (own[:k] if k else [x for x in own if x == own[0]])]
        return sorted(out)

    cost = lambda p: sum(es[i][3] for i in p)
    got = rows(s.execute("SELECT a.k, b.k, COUNT(e) FROM MATCH ANY SHORTEST (a:P)-[e:knows]->*(b:P)"))
    assert got == best(0, 7, 1, len)
    got = rows(s.execute("SELECT a.k, b.k, COUNT(e) FROM MATCH ALL SHORTEST (a:P)-[e:knows]->+(b:P)"))
    assert got == best(1, 7, 0, len)
    got = rows(s.execute("SELECT a.k, b.k, COUNT(e) FROM MATCH TOP 2 SHORTEST (a:P)-[e:knows]->{2,4}(b:P)"))
    assert got == best(2, 4, 2, len)
    for low, high, text in ((0, 3, "{,3}"), (2, 4, "{2,4}")):
        got = rows(s.execute(f"SELECT a.k, b.k, COALESCED FROM MATCH ANY CHEAPEST (a:P) (-[e:knows]-> COST e.w){text} (b:P)".replace("COALESCED", "CASE WHEN COUNT(e) = 0 THEN 0 ELSE SUM(e.w) END")))
        assert got == best(low, high, 1, cost)
    got = rows(s.execute("SELECT a.k, b.k, SUM(e.w) FROM MATCH ALL (a:P)-[e:knows]->{1,2}(b:P)"))
    assert got == sorted((a[1], v[1], cost(p)) for a in people for v, p in found[a] if 1 <= len(p) <= 2)
    for low, high, text in ((0, 7, "*"), (1, 7, "+"), (2, 2, "{2}"), (0, 1, "?"), (3, 7, "{3,}")):
        got = rows(s.execute(f"SELECT a.k, b.k FROM MATCH (a:P)-/:knows{text}/->(b)"))
        longer = {a: walks(es, a, 9) for a in people} if high == 7 else found
        assert got == sorted({(a[1], v[1]) for a in people for v, p in longer[a] if low <= len(p) and (high == 7 or len(p) <= high)}), text
    got = rows(s.execute("SELECT a.k, ARRAY_AGG(v.k) FROM MATCH ALL (a:P) ((u)-[e:knows]->(v) WHERE u.c = v.c){2} (b:P)"))
    assert sorted(map(str, got)) == sorted(str((a[1], [es[i][2][1] for i in p])) for a in people for v, p in found[a] if len(p) == 2 and all(color[es[i][1]] == color[es[i][2]] for i in p))
    got = rows(s.execute("SELECT a.k, COUNT(e) FROM MATCH ANY SHORTEST (a:P)<-[e:knows]-+(b:P) WHERE b.k = 0"))
    assert got == sorted((b, n) for a, b, n in best(1, 7, 1, len) if a == 0)


def test_macros(spark):
    s, vs, color, es = make(spark, 5)
    pairs = {(a, d) for t, a, b, _ in es if t == "knows" for u, c, d, _ in es if u == "owns" and c == b}
    got = rows(s.execute("PATH drives AS (a)-[:knows]->(b)-[:owns]->(c) SELECT a.k, c.k FROM MATCH (a)-/:drives/->(c)"))
    assert got == sorted((a[1], d[1]) for a, d in pairs)
