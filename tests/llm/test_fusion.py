import json
import random

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import fusion

DDL = "sibling_id bigint, key string, node string, value binary, vector_clock map<string,bigint>, tombstone boolean, fields string, clk string"


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    out = {}
    for k, g in by.items():
        if len(g) < 2:
            continue
        at = lambda r, n: (r[4] or {}).get(n, 0)
        nodes = {n for r in g for n in (r[4] or {})}
        above = lambda b, a: all(at(a, n) <= at(b, n) for n in nodes) and any(at(a, n) < at(b, n) for n in nodes)
        alive = [r for r in g if not r[5] and not any(above(b, r) for b in g)]
        if alive:
            n = lambda r: len(fusion.filled_in(r[3]) or [])
            best = min(alive, key=lambda r: (-n(r), r[0]))
            out[k] = (best[0], n(best))
    return out


def values(rng):
    kind = rng.random()
    if kind < 0.1:
        return rng.choice([None, b"", b"{", b"[1]", b'{"a":"\xff"}', b"null", b'{"a": NaN}', b'{"a":1} x'])
    o = {f: rng.choice(["x", "y", "z", " ", "N/A", "tbd", "?", None, 0, 7, [], {"q": 1}, True]) for f in rng.sample(["team", "plan", "area", "note"], rng.randint(0, 4))}
    return json.dumps(o).encode()


def data(n, seed, hot=0.3):
    rng = random.Random(seed)
    clock = lambda: rng.choice([None, {}, {rng.choice("abcd"): rng.randint(0, 5) for _ in range(rng.randint(1, 4))}])
    return [(i, "hot" if rng.random() < hot else rng.choice([None, "", *[f"k{j}" for j in range(n // 5)]]), rng.choice(["n1", "n2", "n3", None]), values(rng), clock(), rng.choice([True, False, False, None]), "x", "y") for i in range(n)]


def run(spark, rows, **kw):
    return fusion.fuse_groups(spark.createDataFrame(rows, DDL), **kw)


def test_survivors_against_brute_force(spark):
    rows = data(900, 5)
    rows += [(10_000 + i, *r[1:]) for i, r in enumerate(rows[:100])]  # repeated rows
    got = run(spark, rows).collect()
    assert {r.key: (r.sibling_id, r.n_filled) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_antichain(spark):
    rows = [(i, "k", "n", b'{"a":1}', {"a": i, "b": 60 - i}, False, "", "") for i in range(60)] + [(99, "k", "n", b'{"a":1,"b":2}', {"a": 3, "b": 4}, False, "", "")]
    got = run(spark, rows).collect()
    assert [(r.key, r.sibling_id) for r in got] == [("k", 0)]


def test_fields():
    f = fusion.filled_in
    assert f(b'{"a":"x","b":" ","c":null,"d":"TBD","e":0,"f":false}') == [("a", "x"), ("e", "0"), ("f", "false")]
    assert f(b"[1]") is None and f(b"") is None and f(None) is None and f(b'{"a":1}{}') is None and f(b'{"a":NaN}') is None
    assert f(b"[" * 100_000) is None
    assert f(("{\"a\":\"" + "x" * 1_000_000 + "\"}").encode())[0][1] == "x" * 1_000_000


def test_edges(spark):
    assert run(spark, []).count() == 0
    assert run(spark, [(1, "a", "n", b"{}", None, None, "", "")]).count() == 0
    two = [(1, "a", None, None, None, None, "", ""), (2, "a", None, b"{}", {"x": 0}, False, "", "")]
    assert [(r.key, r.sibling_id, r.n_filled, r.record) for r in run(spark, two).collect()] == [("a", 1, 0, None)]
    dead = [(1, "a", "n", b"{}", {"x": 1}, True, "", ""), (2, "a", "n", b"{}", None, False, "", "")]
    assert run(spark, dead).count() == 0


def test_copied_votes_are_discounted(spark):
    """Three copies of a poor source often outvote four fair ones that disagree; fusion must see through them."""
    rng = random.Random(7)
    rows, truth, i = [], {}, 0
    for k in range(400):
        truth[f"k{k}"] = str(rng.randint(0, 50))
        good = lambda: truth[f"k{k}"] if rng.random() < 0.75 else str(rng.randint(0, 50))  # noqa: E731, B023
        bad = truth[f"k{k}"] if rng.random() < 0.4 else str(rng.randint(0, 50))
        for j, v in enumerate([bad, good(), bad, good(), good(), bad, good()]):
            rows.append((i, f"k{k}", f"s{j}", json.dumps({"a": v}).encode(), {f"s{j}": 1}, False, "", ""))
            i += 1
    got = {r.key: r.record["a"] for r in run(spark, rows).collect()}
    fused = np.mean([got[k] == v for k, v in truth.items()])
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(json.loads(r[3])["a"])
    majority = np.mean([max(sorted(set(g)), key=g.count) == truth[k] for k, g in by.items()])
    assert majority < 0.85 and fused > 0.93, (majority, fused)


def test_posteriors(spark):
    r = run(spark, [(1, "a", "n1", b'{"f":"x"}', {"p": 1}, False, "", ""), (2, "a", "n2", b'{"f":"x"}', {"q": 1}, False, "", ""), (3, "a", "n3", b'{"f":"y","g":"z"}', {"r": 1}, False, "", "")]).collect()[0]
    assert r.record == {"f": "x", "g": "z"} and 0.5 < r.confidence["f"] <= 1 and r.sibling_id == 3


def test_source_report(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        truth, wrong = str(k), str(rng.randint(1000, 1020))
        for j, v in enumerate([truth, truth if rng.random() < 0.9 else "x", truth if rng.random() < 0.9 else "y", wrong, wrong]):
            rows.append((len(rows), f"k{k}", f"s{j}", json.dumps({"a": v}).encode(), {f"s{j}": 1}, False, "", ""))
    report = {r.source: r for r in fusion.source_report(spark, fusion.fuse(spark.createDataFrame(rows, DDL)).sources).collect()}
    assert min(report[f"s{j}"].accuracy for j in range(3)) > 0.8 > 0.4 > max(report[f"s{j}"].accuracy for j in (3, 4))
    assert report["s3"].likeliest_copy == "s4" and report["s3"].copy_probability > 0.9 > report["s0"].copy_probability
