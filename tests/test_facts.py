"""Rules that are easy to get wrong, each on a few rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from factweave.functions import columns as C
from factweave.operators import aggregate, approvals, audit, changes, curate, graph, resolve, temporal, vector, windows
from factweave.streaming import ledger


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if hasattr(v, "alias") else F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("3", 3), ("9", 5), ("-2", 1), ("4.7", 1), (" 5 ", 5), (None, 1), ("x", 1)])
def test_importance(spark, raw, want):
    assert one(spark, C.clamp_importance(F.col("c")), c=F.lit(raw).cast("string")) == want


def test_confidence_bounds_differ(spark):
    assert one(spark, C.clamp_confidence(F.lit("1.5"))) == 0.99
    assert one(spark, C.clamp_confidence(F.lit("1.5"), 0.0, 1.0)) == 1.0


def test_intervals(spark):
    v = spark.sql("select 'a' k, 1 version, 'm1' memory_id, timestamp'2020-01-01' valid_from, timestamp'2020-02-01' valid_to")
    i = spark.sql("select 'a' k, timestamp'2020-02-01' instant")
    assert windows.as_of(v, i, "k").count() == 0 and windows.as_of(v, i, "k", closed=True).count() == 1
    two = v.unionByName(spark.sql("select 'a' k, 2 version, 'm2' memory_id, timestamp'2020-02-01' valid_from, cast(null as timestamp) valid_to"))
    r = windows.as_of(two, i, "k", closed=True).first()
    assert (r.memory_id, r.n_matches) == ("m2", 2)


def test_missing_times(spark):
    now, none = F.to_timestamp(F.lit("2024-01-31")), F.lit(None).cast("timestamp")
    assert one(spark, C.age_days(none, now)) == 0 and math.isinf(one(spark, C.age_days(none, now, float("inf"))))
    assert one(spark, C.item_lifecycle(F.lit(1), F.lit(30.0))) == "aging" and one(spark, C.entity_lifecycle(F.lit(30.0), F.lit(False))) == "ACTIVE"
    assert one(spark, C.item_lifecycle(F.lit(4), F.lit(900.0))) == "active" and one(spark, C.entity_lifecycle(F.lit(float("inf")), F.lit(False))) == "DORMANT"


def test_names(spark):
    assert one(spark, C.canonical_name(F.lit("  Groß   Weiß "))) == "gross weiss"
    assert one(spark, C.clean_aliases(F.array(F.lit("Bob"), F.lit("bob "), F.lit("AL"), F.lit("")), F.lit("al"))) == ["Bob"]
    assert one(spark, C.keep_newest(F.array(*[F.lit(i) for i in range(5)]), 2)) == [3, 4]


def test_cosine_of_nothing(spark):
    empty = F.array().cast("array<double>")
    assert one(spark, vector.cosine(empty, empty)) == 0 and one(spark, vector.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0


def test_supersede(spark):
    items = spark.sql("select 'm1' memory_id, 'c' chain_id, 1 version, timestamp'2020-01-01' valid_from, cast(null as timestamp) valid_to, cast(null as string) superseded_by, 'old' memory")
    batch = spark.sql("select 'c' chain_id, 'm2' new_id, 'new' memory, timestamp'2021-01-01' effective_from union all select 'zz', 'm3', 'x', timestamp'2021-01-01'")
    new, out = changes.supersede(items, batch)
    got = {r.memory_id: r for r in new.collect()}
    assert got["m1"].superseded_by == "m2" and got["m2"].version == 2 and got["m2"].valid_to is None
    assert {r.new_id: r.outcome for r in out.collect()} == {"m2": "SUPERSEDED", "m3": "NO_CURRENT"}
    early = changes.supersede(items, batch.withColumn("effective_from", F.to_timestamp(F.lit("2019-01-01"))))[1]
    assert {r.outcome for r in early.collect()} == {"TOO_EARLY", "NO_CURRENT"}


def test_add_items_twice(spark):
    active, archive = spark.sql("select 'known' memory"), spark.sql("select 'old' memory")
    batch = spark.createDataFrame([(1, "new"), (2, " new "), (3, "known"), (4, "old"), (5, " "), (6, None)], "ord int, memory string")
    assert [r.outcome for r in temporal.add_items(active, archive, batch).orderBy("ord").collect()] == ["ADDED", "DUPLICATE", "DUPLICATE", "RESTORE", "BLANK", "BLANK"]


def test_moves(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, s string"), spark.createDataFrame([(2, "old")], "id int, s string")
    left, right = windows.move(a, b, spark.createDataFrame([(2,)], "id int"), "id", s=F.lit("moved"))
    assert [r.id for r in left.collect()] == [1] and [(r.id, r.s) for r in right.collect()] == [(2, "moved")]


def test_pack_skips_and_goes_on(spark):
    df = spark.createDataFrame([("g", 1, 0.9, 50), ("g", 2, 0.8, 60), ("g", 3, 0.7, 40)], "g string, i int, s double, c int")
    r = windows.pack_by_budget(df, "g", 100, "s", "c", "i").first()
    assert (r.used, list(r["items"])) == (90, [1, 3])


def test_edges_first_family_wins(spark):
    items = spark.sql("select 'a' memory_id, 'c' chain_id, 1 version, 1 valid_from, cast(null as string) supersedes, 'b' superseded_by, array('z', 'a') derived_from union all select 'b', 'c', 2, 2, 'a', null, array()")
    none = spark.createDataFrame([], "memory_id string, entity_id string")
    rel = spark.createDataFrame([("e", "f", "KNOWS", False, 0.7)], "source string, target string, relation string, directed boolean, confidence double")
    got = {(r.source, r.target, r.relation) for r in graph.build_edges(items, none, rel, rel.limit(0)).collect()}
    assert got == {("e", "f", "KNOWS"), ("f", "e", "KNOWS"), ("b", "a", "SUPERSEDES"), ("a", "b", "SUPERSEDED_BY"), ("a", "z", "DERIVED_FROM"), ("a", "b", "NEXT_VERSION")}


def test_blocked_resolution(spark):
    ents = spark.createDataFrame([(1, "Apollo Data Platform", "PROJECT"), (2, "Apollo Music", "PRODUCT"), (3, "Zeus", "PERSON")], "entity_id int, name string, type string")
    cand = spark.createDataFrame([(1, "apollo data platform", "PROJECT"), (2, "nothing", "OTHER"), (3, "the Zeus", "PERSON")], "candidate_id int, name string, type string")
    got = {r.candidate_id: (r.entity_id, r.decision) for r in resolve.resolve(cand, ents).collect()}
    assert got == {1: (1, "MATCHED"), 2: (None, "NOT_FOUND"), 3: (3, "MATCHED")}


@pytest.mark.parametrize("score,ct,et,amb,exact,core,want", [
    (0.99, "PERSON", "PROJECT", False, True, True, "DIFFERENT"), (0.99, "PERSON", "PERSON", True, False, True, "POSSIBLE_CONFLICT"), (0.99, "PERSON", "PERSON", False, True, True, "POSSIBLE_CONFLICT"),
    (0.7, "CONCEPT", "CONCEPT", False, True, True, "SAME"), (0.93, "CONCEPT", "OTHER", False, False, False, "SAME"), (0.7, "CONCEPT", "CONCEPT", False, False, False, "POSSIBLE_CONFLICT"), (0.5, "X", "X", False, False, False, "DIFFERENT")])
def test_identity_gate(spark, score, ct, et, amb, exact, core, want):
    assert one(spark, resolve.judge(*[F.lit(x) for x in (score, ct, et, amb, exact, core)])) == want


def test_relation_upsert(spark):
    ents = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    old = spark.createDataFrame([("a", "b", "R", 0.9, "first", ["m1"])], "source string, target string, relation string, confidence double, evidence string, memory_ids array<string>")
    new = spark.createDataFrame([("a", "b", "R", 0.7, "", "m2", 1), ("a", "a", "R", 0.9, "x", "m3", 2), ("a", "c", "R", 0.9, "x", "m3", 3), ("a", "b", "R", 0.5, "low", "m4", 4)], "source string, target string, relation string, confidence double, evidence string, memory_id string, seq long")
    r = aggregate.upsert_relations(old, new, ents).collect()
    assert len(r) == 1 and (r[0].confidence, r[0].evidence, r[0].memory_ids) == (0.9, "first", ["m1", "m2"])


def test_repair_then_clean(spark):
    ents = spark.createDataFrame([(1, ["a", "", "a", "zz", "b"]), (2, [])], "entity_id int, memory_ids array<string>")
    items = spark.createDataFrame([("a",), ("b",)], "memory_id string")
    assert {(r.code, r.n) for r in audit.audit_links(ents, items).collect()} == {("ENTITY_EMPTY_MEMORY_LINK", 1), ("ENTITY_DUPLICATE_MEMORY_LINK", 1), ("ENTITY_MEMORY_REFERENCE_MISSING", 1)}
    fixed = audit.repair_links(ents, items)
    assert {r.entity_id: (r.memory_ids, r.removed) for r in fixed.collect()} == {1: (["a", "b"], 3), 2: ([], 0)}
    assert audit.audit_links(fixed, items).count() == 0 and {r.removed for r in audit.repair_links(fixed, items).collect()} == {0}


def test_entity_audit(spark):
    s = "entity_id string, archive_state string, lifecycle_status string, temporal_status string, version int, history_versions array<int>"
    active = spark.createDataFrame([("e1", "ACTIVE", "ACTIVE", "current", 2, [1]), ("e2", "ACTIVE", "ACTIVE", "ended", 1, [3, None]), ("", "ARCHIVED", "x", "ended", 1, None), ("e3", "ACTIVE", "ACTIVE", "current", 1, None)], s)
    archive = spark.createDataFrame([("e3", "ACTIVE", "DORMANT", "current", 1, None), ("e4", "ARCHIVED", "ACTIVE", "current", 1, None)], s)
    assert {(r.code, r.key) for r in audit.audit_entities(active, archive).collect()} == {
        ("ENTITY_ENDED_LIFECYCLE_MISMATCH", "e2"), ("ENTITY_HISTORY_INVALID_VERSION", "e2"), ("ENTITY_HISTORY_CURRENT_VERSION_COLLISION", "e2"), ("ENTITY_MISSING_ID", ""),
        ("ARCHIVE_ENTITY_NOT_ARCHIVED", "e3"), ("ENTITY_ACTIVE_ARCHIVE_OVERLAP", "e3"), ("ARCHIVE_ENTITY_ACTIVE_STATE_MISMATCH", "e3"), ("ENTITY_ARCHIVE_LIFECYCLE_MISMATCH", "e4"), ("ARCHIVE_INVALID_LIFECYCLE", "e4")}


def test_interval_gate(spark):
    e = spark.createDataFrame([("k", t) for t in (0, 5, 10, 12, 25)], "k string, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r.s for r in ledger.one_per_interval(e, "k", "ts", 10).select(F.unix_seconds("ts").alias("s")).collect()) == [0, 10, 25]


def test_dedupe_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, s int").select("k", F.timestamp_seconds("s").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = ledger.dedupe_stream(spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in"), "k", "ts")
    q = stream.writeStream.format("memory").queryName("deduped").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.k for r in spark.sql("select k from deduped").collect()} == {"a", "b"} and spark.sql("select * from deduped").count() == 2


def test_text_rules(spark):
    good, bad = "x\n|a|b|\n|--|--|\n|1|2|\nend", "|a|b|\n|1|2|"
    assert one(spark, curate.tables_ok(F.lit(good))) and not one(spark, curate.tables_ok(F.lit(bad))) and not one(spark, curate.tables_ok(F.lit("|a|b|")))
    raw = spark.createDataFrame([(1, 'ok {"facts":[{"text":"likes tea"},{"text":"password: x"},{"text":" "}]} end'), (2, "{broken"), (3, None), (4, "")], "k int, raw string")
    assert [(r.k, r.memory, r.type, r.importance) for r in curate.fact_rows(raw, "raw", "k").collect()] == [(1, "likes tea", "other", 3)]


@pytest.mark.parametrize("text,want", [("Abaqus FEA Software", ["abaqus"]), ("finite element analysis", []), ("analysis", ["analysis"]), ("آباکوس", ["abaqus"]), ("The Zeus-Project (v2)", ["the", "zeus", "project", "v2"]), (None, [])])
def test_core_tokens(spark, text, want):
    assert one(spark, C.core_tokens(F.col("c")), c=F.lit(text).cast("string")) == want


def test_vocabularies(spark):
    assert [one(spark, C.norm_entity_type(F.lit(x).cast("string"))) for x in ("app", "org", "City", None)] == ["SOFTWARE", "ORGANIZATION", "OTHER", "OTHER"]
    assert [one(spark, C.canonical_relation(F.lit(x))) for x in ("results in", "depends-on", "RELATED")] == ["LEADS_TO", "DEPENDS_ON", "RELATED_TO"]
    assert [one(spark, C.guess_type(F.lit(x).cast("string"))) for x in ("Learning Abaqus", "uses SolidWorks", "my goal", "پروژه", "x", None)] == ["learning", "tool", "goal", "project", "other", "other"]
    assert one(spark, C.result_ref(F.lit('{"memory_id":"m","entity_id":"e"}'))) == "e"


@pytest.mark.parametrize("text,want", [
    ("```md\nbody {p}\n```", True), ("<u>{p}</u>", True), ("<u>{p}", False), ("<b>{p}</b>", False), ("cost $5 {p}", False), ("$a+b$ {p} $$x\ny$$", True), ("Sorry, {p}", False), ("{p}\n|a|b|\n|1|2|", False), ("{p}\n|a|b|\n|:--|--:|\n|1|2|", True), ("short", False), (None, False)])
def test_rich_text(spark, text, want):
    text = text and text.replace("{p}", "plain words here " * 6)
    assert one(spark, curate.rich_accepted(curate.rich_text(F.col("c"))), c=F.lit(text).cast("string")) == want


def test_candidates_of_replies(spark):
    raw = spark.createDataFrame([(1, """{"entities":[{"name":"Bob","type":"person","confidence":0.7},{"name":"BOB","type":"person","confidence":0.9,"aliases":["bob","Bobby"]},{"name":"x","confidence":0.5}],
      "relations":[{"source":"bob","target":"Acme","relation":"works with","confidence":0.8},{"source":"bob","target":"bob","relation":"works with","confidence":0.8},{"source":"bob","target":"nobody","relation":"builds","confidence":0.8}],
      "evolutions":[{"entity_id":"e1","action":"end"},{"entity_id":"e9","action":"END"},{"entity_id":"e1","action":"none"}]}"""), (2, "{broken"), (3, None)], "k int, raw string")
    known = spark.createDataFrame([("e1", "Bob"), ("e2", "Acme")], "entity_id string, name string")
    assert [(r.name, r.type, r.confidence, r.aliases) for r in curate.entity_candidates(raw, "raw", "k").collect()] == [("BOB", "PERSON", 0.9, ["Bobby"])]
    assert [(r.source, r.target, r.relation) for r in curate.relation_candidates(raw, "raw", "k", known).collect()] == [("e1", "e2", "WORKS_WITH")]
    assert [(r.entity_id, r.action) for r in curate.evolution_candidates(raw, "raw", "k", known).collect()] == [("e1", "END")]


def test_facts_may_be_strings(spark):
    raw = spark.createDataFrame([(1, '{"facts":["plain",{"text":"obj","type":"goal","importance":5},{"text":"sk-abcdefghij12"},"a","b"]}')], "k int, raw string")
    assert [(r.memory, r.type, r.importance) for r in curate.fact_rows(raw, "raw", "k").collect()] == [("plain", "other", 3), ("obj", "goal", 5), ("a", "other", 3)]


def test_similar_pairs_brute_force(spark):
    """Against pairs compared one by one: odd vectors, equal ones, other lengths, several blocks, any width of slices."""
    rng = random.Random(3)
    vecs = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(40)]
    vecs += [vecs[0], vecs[1], [0.0] * 5, [], None, [1.0, None, 2.0, 0.0, 1.0], [1.0, 2.0], [float("nan")] * 5]
    rows = spark.createDataFrame([(i, v, f"n{i}") for i, v in enumerate(vecs)], "key long, vector array<double>, query_name string")
    asked = rows.where("key % 3 = 0 or key >= 40").select(F.col("key").alias("query_id"), "vector")

    def size(v):
        return math.sqrt(sum(x * x for x in v)) if v and all(x is not None and x == x for x in v) else 0.0

    def sim(a, b):
        if not size(a) or not size(b):
            return 0.0
        return sum(x * y for x, y in zip(a, b)) / (size(a) * size(b)) if len(a) == len(b) else None

    for least in (0.3, 0.0, -1.0):
        want = {(q, k): s for q in range(len(vecs)) if q % 3 == 0 or q >= 40 for k in range(len(vecs)) if (s := sim(vecs[q], vecs[k])) is not None and s >= least}
        for blocks in (1, 3):
            out = vector.similar_pairs(asked, rows, least, blocks)
            got = {(r.query_id, r.key): r.sim for r in out.collect()}
            assert out.columns == ["key", "query_name", "query_id", "sim"] and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in got)
    same = {r.key: r.sim for r in vector.similar_pairs(asked.where("query_id = 3"), rows, -1.0).collect()}
    assert same[0] == same[40] and same[1] == same[41]
    assert vector.similar_pairs(asked.limit(0), rows, 0.0).count() == 0 and vector.similar_pairs(asked, rows.limit(0), 0.0).count() == 0


def test_with_vectors(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "i int, t string")
    got = {r.i: r.vector for r in vector.with_vectors(df, "t", lambda texts: [[len(t), 1.0] for t in texts]).collect()}
    assert got == {1: [2.0, 1.0], 2: None, 3: [0.0, 1.0]} and vector.with_vectors(df.where("false"), "t", lambda texts: []).count() == 0


def test_bound_to(spark):
    """Each rule in its order; a policy that asks for nothing lets all but wrong bindings and delegations pass."""
    cols = "plan_id string, actor string, role string, requester string, requester_role string, policy_version int, policy_fingerprint string, plan_fingerprint string, previous_id string, previous_key string, delegated_by string, delegation_reference string"
    row = lambda **k: tuple((dict(plan_id="p", actor="a", role="r", requester="q", requester_role="s", policy_version=1, policy_fingerprint="f", plan_fingerprint="g", previous_id=None, previous_key=None, delegated_by=None, delegation_reference=None) | k).values())
    plans = spark.createDataFrame([("p", 1, "f", "g", None, None)], "plan_id string, policy_version int, policy_fingerprint string, plan_fingerprint string, previous_id string, previous_key string")
    codes = lambda need, *rows: [r.code and r.code[9:] for r in approvals.bound_to(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{cols}, i int"), plans, need).orderBy("i").collect()]
    assert codes(approvals.Requirement(), row(), row(plan_id="x"), row(policy_fingerprint="z"), row(plan_fingerprint=None), row(previous_id="o"), row(delegated_by="d"), row(actor="q")) == [
        None, "POLICY_VERSION_MISMATCH", "POLICY_FINGERPRINT_MISMATCH", "REPAIR_PLAN_MISMATCH", "CYCLE_MISMATCH", "DELEGATION_NOT_ALLOWED", None]
    strict = approvals.Requirement(True, True, True, (), True, True, True)
    assert codes(strict, row(), row(requester=" "), row(requester_role=None), row(role="s"), row(role=""), row(delegated_by="q"), row(delegated_by="a"), row(delegated_by="d"), row(delegated_by="d", delegation_reference="x"), row(delegation_reference="x")) == [
        None, "REQUESTER_REQUIRED", "REQUESTER_ROLE_REQUIRED", "REQUESTER_ROLE_FORBIDDEN", "ROLE_REQUIRED", "REQUESTER_DELEGATION_FORBIDDEN", "DELEGATOR_SELF_REFERENCE", "DELEGATION_REFERENCE_REQUIRED", None, "DELEGATION_REFERENCE_WITHOUT_DELEGATOR"]
