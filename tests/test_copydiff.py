from keyloom.operators.copydiff import diff_copies, store_fields

DDL = "key string, value binary, version bigint, vector_clock map<string,bigint>, tombstone boolean, field string"


def diff(spark, a, b):
    f = lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], DDL)
    return sorted(((r.key, r.field) for r in diff_copies(f(a), f(b), store_fields()).collect()), key=repr)


def test_fields(spark):
    same = ("s", b"v", 1, {"a": 1, "b": 2}, False)
    a = [same, same, ("s", b"old", None, None, None), ("v", b"", 1, {}, False), ("n", None, None, None, None), ("c", b"", 1, {"a": 0}, False), ("t", b"", 2, None, None), ("only", None, None, None, True), (None, b"x", 1, {}, False)]
    b = [("s", b"v", 1, {"b": 2, "a": 1}, False), ("v", None, 1, {}, False), ("n", None, 0, None, None), ("c", b"", 1, {}, False), ("t", b"", 2, None, False), ("t", b"old", 1, {"z": 1}, True), ("Only", None, None, None, True), (None, b"x", 1, {}, True)]
    want = {("v", "value"), ("n", "version"), ("c", "vector_clock"), ("t", "tombstone"), ("only", "only_a"), ("Only", "only_b"), (None, "tombstone")}
    assert diff(spark, a, b) == sorted(want, key=repr)


def test_empty_sides(spark):
    row = ("k", b"x", 1, {"a": 1}, False)
    assert diff(spark, [], []) == []
    assert diff(spark, [row], []) == [("k", "only_a")]
    assert diff(spark, [], [row] * 3) == [("k", "only_b")]
    assert diff(spark, [row] * 500, [row]) == []
