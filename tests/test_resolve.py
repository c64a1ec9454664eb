"""Resolution, ingest and recovery against pairs compared one by one; stateful streams against a fold."""

import itertools
import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from factweave.functions import columns as C
from factweave.operators import resolve
from factweave.plans import lookups
from factweave.streaming import ledger, stateful

WORDS = ("apollo", "data", "platform", "music", "zeus", "hub")


def by_pairs(spark, cands, ents):
    """Best entity per candidate, every pair compared."""
    texts = {t for _, n, _ in cands for t in [n]} | {t for _, n, al, _ in ents for t in [n, *al]}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.identity_text(F.col("t")).alias("i"), C.core_tokens(F.col("t")).alias("w")).collect()
    ident, core = {r.t: r.i for r in rows}, {r.t: r.w for r in rows}

    def score(a, b):
        x, y = set(core[a]), set(core[b])
        if core[a] and core[a] == core[b]:
            return 0.98
        both = len(x & y)
        part = max(both / len(x | y), 0.9 * both / min(len(x), len(y))) if x and y else 0.0
        return 0.45 * SequenceMatcher(None, ident[a], ident[b]).ratio() + 0.55 * part

    out = {}
    for cid, name, kind in cands:
        s = sorted(((-round(min(1.0, max(score(name, n) for n in [en, *al]) + (0.04 if kind == et != "OTHER" else 0)), 4), eid) for eid, en, al, et in ents))
        best, second = -s[0][0], -s[1][0]
        unclear = best < 0.92 and best - second < 0.08
        out[cid] = "MATCHED" if best >= 0.82 and not unclear else ("AMBIGUOUS" if unclear else "REVIEW") if best >= 0.68 else "NOT_FOUND", s[0][1] if best >= 0.68 else None
    return out


def test_resolve_equals_all_pairs(spark):
    names = [" ".join(p) for n in (1, 2, 3) for p in itertools.permutations(WORDS, n)]
    ents = [(f"e{i:03d}", n, [f"{n} tool"] if i % 3 == 0 else ["Zeus Hub"] if i % 7 == 0 else [], ("PERSON", "OTHER", "PRODUCT")[i % 3]) for i, n in enumerate(names[::4] + names[:3])]
    cands = [(i, n, ("PERSON", "OTHER")[i % 2]) for i, n in enumerate(names[1::3] + ["app", "apolo data"])]
    e = spark.createDataFrame(ents, "entity_id string, name string, aliases array<string>, type string")
    got = {r.candidate_id: (r.decision, r.entity_id if r.decision != "NOT_FOUND" else None) for r in resolve.resolve(spark.createDataFrame(cands, "candidate_id int, name string, type string"), e).collect()}
    assert got == by_pairs(spark, cands, ents)


def test_resolve_hot_token(spark):
    """Names that all share one token: the decisions of all pairs, and no pair for names that a core key decides."""
    rng = random.Random(3)
    make = lambda: f"orbital {''.join(rng.choice('abcdefg') for _ in range(rng.randint(1, 9)))}{rng.choice(['', ' x', ' data hub'])}"
    names = list({make() for _ in range(90)})
    ents = [(f"e{i:03d}", n, [], ("PERSON", "OTHER", "PRODUCT")[i % 3]) for i, n in enumerate(names[:60])]
    cands = [(i, n, ("PERSON", "OTHER")[i % 2]) for i, n in enumerate(names[:30] + names[60:])]
    e, c = spark.createDataFrame(ents, "entity_id string, name string, aliases array<string>, type string"), spark.createDataFrame(cands, "candidate_id int, name string, type string")
    got = {r.candidate_id: (r.decision, r.entity_id if r.decision != "NOT_FOUND" else None) for r in resolve.resolve(c, e).collect()}
    assert got == by_pairs(spark, cands, ents)
    every, made = resolve.token_pairs(c, e).count(), resolve.plausible_pairs(c, e)
    assert made.count() < 0.75 * every and made.where(F.col("a").isin(names[:30])).count() == made.where(F.col("a").isin(names[:30]) & (F.col("jaccard") == 1)).count()


def test_resolve_nothing(spark):
    e = spark.createDataFrame([("e", "Bob", None, None), ("f", None, ["Al"], "PERSON")], "entity_id string, name string, aliases array<string>, type string")
    c = spark.createDataFrame([(1, None, None), (2, " ", "X"), (3, "al", None), (3, "al", None)], "candidate_id int, name string, type string")
    assert sorted((r.candidate_id, r.entity_id, r.decision) for r in resolve.resolve(c, e).collect() if r.entity_id) == [(3, "f", "MATCHED")] * 2
    assert resolve.resolve(c.limit(0), e).count() == 0 and {r.decision for r in resolve.resolve(c, e.limit(0)).collect()} == {"NOT_FOUND"}


ENT = "entity_id string, name string, type string, aliases array<string>, confidence double, description string, memory_ids array<string>, mention_count long"
CAND = "candidate_id int, name string, type string, aliases array<string>, confidence double, description string, memory_ids array<string>"


def test_ingest(spark):
    active = spark.createDataFrame([("e1", "Abaqus", "SOFTWARE", ["aba"], 0.7, "", ["m1"], 1), ("e2", "Bob Stone", "PERSON", None, 0.8, "x", [], 0)], ENT)
    archive = spark.createDataFrame([("a1", "Solidworks", "SOFTWARE", None, 0.5, "cad", ["m0"], 1), ("a2", "Paris", "PLACE", None, 0.5, "", [], 0)], ENT)
    cand = spark.createDataFrame([
        (1, "Abaqus FEA", "SOFTWARE", ["ABQ"], 0.9, "solver", ["m1", "m2"]), (2, "bob stone", "PERSON", [], 0.9, "", ["m3"]), (3, "SolidWorks app", "SOFTWARE", [], 0.6, "", ["m4"]),
        (4, "Paris", "PLACE", [], 0.6, "", ["m5"]), (5, "Brand New", "OTHER", [], 0.6, "", ["m6"]), (6, "brand  new", "OTHER", [], 0.7, "d", ["m7"]), (7, None, None, None, None, None, None)], CAND)
    plan = resolve.ingest_entities(cand, active, archive)
    got = {r.candidate_id: (r.action, r.blocked_by) for r in plan.collect()}
    assert got == {1: ("LINK", None), 2: ("CREATE", "e2"), 3: ("RECOVER", None), 4: ("CREATE", "a2"), 5: ("CREATE", None), 6: ("CREATE", None)}
    log = {r.candidate_id: r.status for r in resolve.recover_entities(cand, archive).collect()}
    assert (log[3], log[4], log[5]) == ("RECOVERED", "BLOCKED", "NOT_FOUND")
    assert {r.candidate_id: r.status for r in resolve.recover_entities(cand, archive, force=True).collect()}[4] == "RECOVERED"
    new, rest = resolve.merge_entities(active, archive, cand, plan)
    rows = {r.name: r for r in new.collect()}
    assert [r.entity_id for r in rest.collect()] == ["a2"] and len(rows) == 6
    assert (rows["Abaqus"].confidence, rows["Abaqus"].description, rows["Abaqus"].memory_ids, rows["Abaqus"].mention_count) == (0.9, "solver", ["m1", "m2"], 2)
    assert sorted(rows["Abaqus"].aliases) == ["ABQ", "Abaqus FEA", "aba"] and rows["Solidworks"].description == "cad"
    assert rows["Brand New"].memory_ids == ["m6", "m7"] and rows["Bob Stone"].memory_ids == [] and rows["bob stone"].memory_ids == ["m3"]


def test_conflict_status_and_log(spark):
    c = spark.createDataFrame([("c1", "ACTIVE", ""), ("c2", "ACTIVE", "")], "conflict_id string, status string, reason string")
    new = resolve.set_conflict_status(c, spark.createDataFrame([("c1", "dismissed", "no"), ("c2", "odd", "x"), ("c9", "RESOLVED", "x")], "conflict_id string, status string, reason string"))
    assert {(r.conflict_id, r.status, r.reason) for r in new.collect()} == {("c1", "DISMISSED", "no"), ("c2", "ACTIVE", "")}
    log = spark.createDataFrame([("a", 1)], "k string, v int")
    assert sorted((r.k, r.v) for r in resolve.append_log(log, spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, v int"), "k").collect()) == [("a", 1), ("b", 2)]


def test_queries_cover_all_candidates(spark):
    sf = "/root/testdata/sf0.001"
    n = lookups.candidates(spark, sf).count()
    assert lookups.QUERIES["entity_resolve"](spark, sf).count() == n == lookups.QUERIES["entity_ingest"](spark, sf).count() == lookups.QUERIES["entity_recover"](spark, sf).count()


def run(stream, name, path):
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_lease_stream(spark, tmp_path):
    e = [("a", 0, "BEGIN"), ("a", 60, "BEGIN"), ("a", 100, "HEARTBEAT"), ("a", 219, "BEGIN"), ("a", 220, "BEGIN"), ("a", 300, "COMPLETE"), ("a", 900, "BEGIN"), ("b", 5, "COMPLETE"),
         *[("c", i * 120, "BEGIN") for i in range(6)]]
    df = spark.createDataFrame(e, "operation_key string, s int, kind string").select("operation_key", F.timestamp_seconds("s").alias("ts"), "kind")
    for i, part in enumerate((df.where("unix_seconds(ts) < 220"), df.where("unix_seconds(ts) >= 220"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/p={i}")
    stream = spark.readStream.schema("operation_key string, ts timestamp, kind string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = {}
    for r in sorted(run(stateful.lease_stream(stream), "leases", tmp_path), key=lambda r: r.ts):
        got.setdefault(r.operation_key, []).append(r.outcome)
    assert got == {"a": ["CLAIMED", "REFUSED", "EXTENDED", "REFUSED", "RECLAIMED", "ENDED", "REFUSED"], "b": ["IGNORED"], "c": ["CLAIMED"] + ["RECLAIMED"] * 3 + ["LIMIT", "REFUSED"]}


def test_interval_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = run(stateful.interval_stream(spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/in"), "user_id", 6 * 3600), "gated", tmp_path)
    assert sorted(map(tuple, got)) == sorted(map(tuple, ledger.one_per_interval(e, "user_id", "ts", 6 * 3600).collect()))


def test_lease_timers(spark, tmp_path):
    """A lease ends by the watermark without an event of its key; operations of the store are known; events have the outcomes of the batch form."""
    make = lambda rows: spark.createDataFrame(rows, "operation_key string, s int, kind string").select("operation_key", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), "kind").coalesce(1)
    parts = [[("a", 0, "BEGIN"), ("b", 0, "BEGIN"), ("c", 5, "BEGIN"), ("old", 6, "BEGIN")], [("b", 100, "HEARTBEAT"), ("c", 110, "COMPLETE"), ("z", 200, "FAIL")], [("z", 900, "BEGIN"), ("b", 901, "BEGIN")]]
    for n, rows in enumerate(parts):
        make(rows).write.parquet(f"{tmp_path}/in/p={n}")
    stream = spark.readStream.schema("operation_key string, ts timestamp, kind string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    store = spark.createDataFrame([("old", "STARTED", 50, 2, 1), ("done", "COMPLETED", None, 1, 0)], "operation_key string, status string, s int, attempts int, recoveries int").withColumn("lease", F.timestamp_seconds(F.col("s") + 1000))
    got = run(stateful.lease_stream(stream, watermark="0 seconds", store=store), "timed", tmp_path)
    said = sorted((r.operation_key, r.ts.timestamp() - 1000, r.outcome, r.recovery_count) for r in got if r.kind == "TIMER")
    assert said == [("a", 120.0, "EXPIRED", 0), ("old", 50.0, "EXPIRED", 1)]
    events = {(r.operation_key, r.kind, r.ts): r.outcome for r in got if r.kind != "TIMER"}
    batch = {(r.operation_key, r.kind, r.ts): r.outcome for r in stateful.lease_batch(make([r for p in parts for r in p])).collect()}
    assert events == batch | {k: "REFUSED" for k in batch if k[0] == "old"} and [v for k, v in events.items() if k[0] == "b"].count("RECLAIMED") == 1


def test_lease_stream_forgets(spark, tmp_path):
    """A key that wasn't written for the time kept is unknown again."""
    batch = lambda n, s: spark.createDataFrame([("a", s, "BEGIN")], "operation_key string, s int, kind string").select("operation_key", F.timestamp_seconds("s").alias("ts"), "kind").coalesce(1).write.parquet(f"{tmp_path}/in/p={n}")
    batch(0, 0)
    stream = spark.readStream.schema("operation_key string, ts timestamp, kind string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = stateful.lease_stream(stream, 15).writeStream.format("memory").queryName("forgotten").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        outcomes = lambda: [r.outcome for r in spark.table("forgotten").orderBy("ts").collect()]
        for n, want in ((1, ["CLAIMED"]), (2, ["CLAIMED", "CLAIMED"])):
            end = time.time() + 60
            while len(outcomes()) < n and time.time() < end:
                time.sleep(0.5)
            assert outcomes() == want
            if n == 1:
                time.sleep(20)
                batch(1, 1)
    finally:
        q.stop()
