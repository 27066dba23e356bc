import random

from keyloom.llm import seen
from keyloom.llm.seen import seen_before

REQ, OLD = "request_id bigint, key string, h string, block string", "key string, id string"


def brute(requests, archive):
    known, out = {k for k, _ in archive if k is not None}, set()
    for i, k, *_ in sorted(requests, key=lambda r: r[0]):
        if k is None:
            continue
        if k in known:
            out.add(i)
        known.add(k)
    return out


def run(spark, requests, archive, **kw):
    return seen_before(spark.createDataFrame(requests, REQ), spark.createDataFrame(archive, OLD), **kw)


def test_against_brute_force(spark):
    rng = random.Random(11)
    keys = ["hot"] * 300 + ["", "Hot", "hot ", None] + [f"k{i}" for i in range(4000)]
    requests = [(i * 3 - 500, rng.choice(keys), "", "") for i in range(6000)]
    rng.shuffle(requests)
    archive = [(rng.choice([*keys[300:], None]), "") for _ in range(800)]
    want = brute(requests, archive)
    roomy = run(spark, requests, archive)
    assert sorted(r.request_id for r in roomy.rows.collect()) == sorted(want)
    # a filter far too small says maybe to nearly all; the answers stay right and the errors are reported
    tight = run(spark, requests, archive, bits_per_key=0.3)
    assert sorted(r.request_id for r in tight.rows.collect()) == sorted(want)
    errors = lambda s: s.errors().collect()
    rate = lambda e: sum(r.disproved for r in e) / sum(r.new_keys for r in e)
    assert rate(errors(roomy)) < 0.02 < 0.3 < rate(errors(tight))
    for s in (roomy, tight):
        e = errors(s)
        new = {k for _, k, *_ in requests if k is not None} - {k for k, _ in archive}
        assert len(e) == seen.BLOCKS and sum(r.new_keys for r in e) == len(new) and sum(r.requests for r in e) == sum(k is not None for _, k, *_ in requests)
        log = [r.id for r in s.disproved().collect()]
        assert len(log) == sum(r.disproved for r in e) and not set(log) & want


def test_many_segments_keep_the_rate(spark):
    df = spark.range(300_000).selectExpr("id as request_id", "concat('k', id) as key")
    for most in (300_000, 3_000):  # one segment, or a hundred
        s = seen_before(df, df.select("key").limit(0), most_keys=most)
        e = s.errors().agg({"disproved": "sum", "new_keys": "sum"}).first()
        assert s.rows.count() == 0 and e["sum(new_keys)"] == 300_000 and e["sum(disproved)"] < 0.02 * 300_000


def test_windows_of_a_split(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(seen, "WINDOW_KEYS", 5)
    rng = random.Random(2)
    data = [(i, rng.choice("abcdefghijkl")) for i in range(400)]
    rng.shuffle(data)
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in data[lo : lo + 7]]), pa.array([k for _, k in data[lo : lo + 7]]), pa.array([hash(k) for _, k in data[lo : lo + 7]])], names=["id", "key", "h"]) for lo in range(0, 400, 7)]
    out = pa.Table.from_batches(list(seen._firsts(False)(iter(batches)))).to_pylist()
    assert sorted(r["id"] for r in out) == list(range(400))
    firsts, known = {r["id"]: r["key"] for r in out if r["key"] is not None}, dict(data)
    assert all(known[i] == k for i, k in firsts.items()) and all(r["h"] == hash(r["key"]) for r in out if r["key"] is not None)
    assert all(any(k == known[i] and j < i for j, k in firsts.items()) for i in range(400) if i not in firsts)


def test_edges(spark):
    req = [(5, "a", "", ""), (7, "a", "", ""), (9, None, "", ""), (11, None, "", "")]
    ids = lambda s: sorted(r.request_id for r in s.rows.collect())
    assert ids(run(spark, req, [])) == [7]
    assert ids(run(spark, req, [("a", ""), ("a", ""), (None, "")])) == [5, 7]
    assert ids(run(spark, [], [("a", "")])) == [] and ids(run(spark, [], [])) == []
    # rows of one id are of one time and don't precede each other
    assert ids(run(spark, [(1, "a", "", ""), (1, "a", "", ""), (2, "a", "", "")], [])) == [2]
    long = "x" * 200_000
    assert ids(run(spark, [(1, long, "", ""), (2, long + "y", "", "")], [(long + "y", "")])) == [2]
    assert run(spark, [], []).errors().count() == 0
