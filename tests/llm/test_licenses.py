import random
import re

from pathloom.llm import licenses as L


def words(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def shingles(ws):
    return [" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))] if ws else []


def brute(rows, templates):
    """Best share over all of the windows that the operator may lay: stretches of the template's length and a quarter."""
    out = {}
    for doc, text in rows:
        ws = words(text)
        for name, notice in templates:
            t = words(notice)
            want = set(shingles(t))
            span = len(t) + max(1, len(t) // 4) - 1
            for a in range(0, max(1, len(ws)), max(1, len(t) // 4)):
                share = len(want & set(shingles(ws[a : a + span]))) / len(want)
                if share >= L.CONTAINMENT:
                    out[doc, name] = max(share, out.get((doc, name), 0))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "licensed under"), (4, "Released  under the\nMIT license!"), (4, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0.")]
    for i in range(10, 40):
        filler = [f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 300))]
        notice = rng.choice(L.TEMPLATES)[1].split()
        if i % 3 == 0:
            notice[rng.randrange(len(notice))] = "other"
        at = rng.randint(0, len(filler))
        rows.append((i, " ".join(filler[:at] + notice + filler[at:])))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string").repartition(4)
    got = {(r.doc_id, r.license): r.containment for r in L.find_licenses(df).collect()}
    want = brute(rows, L.TEMPLATES)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_places_and_empty(spark):
    text = "one two three " + L.TEMPLATES[4][1] + " four"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = L.find_licenses(df).where("license = 'Apache-2.0'").collect()
    assert row.containment == 1.0 and row.first_word <= 3 and row.n_windows >= 1
    assert L.find_licenses(df.limit(0)).collect() == [] and L.find_licenses(df, []).collect() == []


def test_runs_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = L.find_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
