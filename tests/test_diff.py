"""Canonical keys, fingerprints and nested differences."""

import json
import random

from pyspark.sql import functions as F

from factweave.functions import canonical
from factweave.operators import diff


def test_op_key(spark):
    """One key for equal payloads: names in any order at any depth, spacing, last digits; another for other ones."""
    df = spark.range(1)
    s, n = lambda x: F.lit(x), F.lit
    forms = [
        dict(a=F.struct(n(0.1 + 0.2).alias("y"), s("x  y ").alias("x")), b=F.array(s(" q\t"), n(None).cast("string"))), dict(b=F.array(s("q"), n(None).cast("string")), a=F.struct(s("x y").alias("x"), n(0.3).alias("y"))),
        dict(b=F.array(s("q"), n(None).cast("string")), a=F.create_map(s("y"), s("x"))), dict(b=F.array(s("Q"), n(None).cast("string")), a=F.struct(s("x y").alias("x"), n(0.3).alias("y"))),
        dict(b=F.array(s("q"), s("null")), a=F.struct(s("x y").alias("x"), n(0.3).alias("y"))), dict(b=F.array(s("q"), n(None).cast("string")), a=F.struct(s("x y").alias("x"), n(0.30000002).alias("y")))]
    keys = [df.select(canonical.op_key(df, F.lit("add " if i else "ADD"), **f)).first()[0] for i, f in enumerate(forms)]
    assert keys[0] == keys[1] and len(set(keys)) == 5
    maps = [F.create_map(s("b"), n(1), s("a"), n(2)), F.create_map(s("a"), n(2), s("b"), n(1))]
    assert len({df.select(canonical.op_key(df, F.lit("k"), m=m)).first()[0] for m in maps}) == 1
    assert df.select(canonical.text(F.struct(s('a"b').alias("z"), n(-0.0).alias("a"), n(True).alias("t")), df.select(F.struct(s("").alias("z"), n(0.0).alias("a"), n(True).alias("t"))).schema[0].dataType)).first()[0] == '{"a":0.0,"t":true,"z":"a\\"b"}'


def test_fingerprint(spark):
    """The order of rows and columns doesn't count; any change does, also two that would cancel in a sum; repeated rows do."""
    rng = random.Random(1)
    rows = [(k, rng.choice("abc"), rng.random()) for k in range(300)] + [(1, "a", 0.5)] * 3
    make = lambda r: spark.createDataFrame(r, "i int, s string, x double")
    of = lambda r, depth=None: diff.fingerprint(make(r), depth=depth).first()[0]
    base = of(rows)
    assert base == of(rows[::-1]) == diff.fingerprint(make(rows), "x", "s", "i").first()[0]
    swapped = [(0, *rows[1][1:]), (1, *rows[0][1:]), *rows[2:]]
    assert len({base, of(rows[1:]), of(rows[:-1]), of(swapped), of([]), of(rows, 2)}) == 6
    assert diff.depth_for(10) == 0 and diff.depth_for(10**6) == 3
    after = [(i, "z" if i == 77 else s, x) for i, s, x in rows if i != 5]
    ranges = diff.differing(make(rows[:300]), make(after[:299]), "i", depth=2).collect()
    assert 1 <= len(ranges) <= 2 and all(any(r.low <= k <= r.high for r in ranges) for k in (5, 77)) and sum(r.rows_before - r.rows_after for r in ranges) == 1


def plain_changes(b, a, path="$"):
    if type(b) is not type(a):
        return [(path, "type_changed")]
    if isinstance(b, dict):
        out = []
        for k in sorted({*b, *a}):
            out += [(f"{path}.{k}", "added")] if k not in b else [(f"{path}.{k}", "removed")] if k not in a else plain_changes(b[k], a[k], f"{path}.{k}")
        return out
    if isinstance(b, list):
        if len(b) > 50 or len(a) > 50:
            return [(path, "collection_rebuilt")] if b != a else []
        out = []
        for i in range(max(len(b), len(a))):
            out += [(f"{path}[{i}]", "added")] if i >= len(b) else [(f"{path}[{i}]", "removed")] if i >= len(a) else plain_changes(b[i], a[i], f"{path}[{i}]")
        return out
    return [(path, "value_changed")] if b != a else []


def test_nested(spark):
    rng = random.Random(2)
    value = lambda: {"s": {"x": rng.choice([1, 2, None]), "y": rng.choice(["a", "b"])}, "l": [{"q": rng.choice([1, 2])} for _ in range(rng.choice([0, 1, 3]))], "m": {k: rng.choice([1, 2]) for k in rng.sample("abc", 2)}, "big": [rng.choice([1, 2])] * rng.choice([3, 51])}
    schema = "key int, s struct<x:int,y:string>, l array<struct<q:int>>, m map<string,int>, big array<int>"
    rows = [(k, value(), value()) for k in range(60)]
    make = lambda n: spark.read.schema(schema).json(spark.createDataFrame([(json.dumps({"key": r[0], **r[n]}),) for r in rows], "v string").rdd.map(lambda r: r.v))
    before, after = make(1), make(2)
    got = sorted((r.key, r.path, r.change) for r in diff.nested_diff(before, after.where("key <> 7"), "key").collect())
    assert got == sorted([(k, *c) for k, b, a in rows if k != 7 for c in plain_changes(b, a)] + [(7, "$", "removed")])
    plan = diff.change_plan({"t": (before, after), "same": (before, before)}, "key", 20).collect()
    assert len(plan) == 20 and all(r.cut and r.n_changes == sum(len(plain_changes(b, a)) for _, b, a in rows) and r.table == "t" for r in plan)
    other = after.withColumn("s", F.struct(F.col("s.y").alias("y"), F.lit(1).alias("z"))).withColumn("l", F.lit("text"))
    kinds = {(r.path, r.change) for r in diff.nested_diff(before, other, "key").collect()}
    assert {("$.s.x", "removed"), ("$.s.z", "added"), ("$.l", "type_changed")} <= kinds
