"""Batches with several changes of one key against one change after the other."""

import random
from datetime import datetime, timedelta

import pytest

from factweave.operators import changes

DAY0 = datetime(2020, 1, 1)
ITEM = "memory_id string, chain_id string, version int, valid_from timestamp, valid_to timestamp, superseded_by string, supersedes string, memory string, temporal_status string, status string"


def day(n):
    return None if n is None else DAY0 + timedelta(days=n)


def plain_supersede(items, batch):
    items, out, seen = [dict(x) for x in items], [], set()
    for ord_, chain, new, text, eff in batch:
        text = (text or "").strip()
        now = [x for x in items if x["chain_id"] == chain and x["valid_to"] is None]
        old = max(now, key=lambda x: x["version"]) if now else None
        if not text:
            said = "BLANK"
        elif new is None:
            said = "NO_ID"
        elif any(x["memory_id"] == new and x["chain_id"] == chain and not x.get("fresh") for x in items):
            said = "KNOWN_ID"
        elif new in seen:
            said = "REPEATED"
        elif old is None:
            said = "NO_CURRENT"
        elif old["valid_from"] is not None and eff < old["valid_from"]:
            said = "TOO_EARLY"
        else:
            said = "SUPERSEDED"
            old |= {"valid_to": eff, "superseded_by": new, "temporal_status": "historical"}
            items.append({"memory_id": new, "chain_id": chain, "version": old["version"] + 1, "valid_from": eff, "valid_to": None, "superseded_by": None, "supersedes": old["memory_id"], "memory": text, "temporal_status": "current", "fresh": True})
        seen.add(new)
        out.append((ord_, said))
    return items, out


@pytest.mark.parametrize("seed", [1, 2])
def test_supersede_in_order(spark, seed):
    rng = random.Random(seed)
    items = []
    for c in range(12):
        for v in range(1, rng.randint(1, 3) + 1):
            items.append((f"m{c}_{v}", f"c{c}", v, day(v * 5), day(v * 5 + 5), None, None, "t", "historical", "active"))
        items[-1] = (*items[-1][:4], None, *items[-1][5:]) if c % 5 else items[-1]
    batch, ids = [], [None, "m3_1", "m4_1"] + [f"n{k}" for k in range(60)]
    for k in range(120):
        batch.append((k, f"c{rng.choice([0, 1, 2, 3, 4, 7, 99])}", rng.choice(ids), rng.choice(["x", "y", " ", None]) if rng.random() < 0.3 else "new", day(rng.randint(0, 40))))
    rows = spark.createDataFrame(batch, "ord int, chain_id string, new_id string, memory string, effective_from timestamp")
    frame = spark.createDataFrame(items, ITEM)
    got, out = changes.supersede(frame, rows)
    want, said = plain_supersede([dict(zip([c.split()[0] for c in ITEM.split(", ")], x, strict=True)) for x in items], batch)
    cols = ["memory_id", "chain_id", "version", "valid_from", "valid_to", "superseded_by", "supersedes", "memory", "temporal_status"]
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(str(tuple(x[c] for c in cols)) for x in want)
    assert sorted((r.ord, r.outcome) for r in out.collect()) == sorted(said)
    again, repeated = changes.supersede(got, rows)
    assert again.count() == got.count() and not [r for r in repeated.collect() if r.outcome == "SUPERSEDED"]


def test_equal_rows_change_once(spark):
    items = spark.createDataFrame([("m1", "c", 1, day(0), None, None, None, "t", "current", "active")], ITEM)
    batch = spark.createDataFrame([("c", "n1", "new", day(3))] * 3, "chain_id string, new_id string, memory string, effective_from timestamp")
    got, out = changes.supersede(items, batch)
    assert got.count() == 2 and sorted(r.outcome for r in out.collect()) == ["REPEATED", "REPEATED", "SUPERSEDED"]
    ends = spark.createDataFrame([("m1", day(4))] * 2 + [("m1", day(2)), ("m1", day(-1)), ("zz", day(1)), (None, day(1))], "memory_id string, ended_at timestamp")
    active, archive, said = changes.end_and_archive(items, items.limit(0), ends, changes.F.lit(day(9)))
    assert active.count() == 0 and [(r.memory_id, r.valid_to, r.temporal_status, r.status) for r in archive.collect()] == [("m1", day(2), "ended", "archived")]
    assert sorted(r.outcome for r in said.collect()) == ["ALREADY_ENDED", "ALREADY_ENDED", "ENDED", "NOT_AFTER_START", "NOT_FOUND", "NOT_FOUND"]
    assert changes.end_items(items, ends).count() == 1


def test_evolve_in_order(spark):
    """Names, types, versions and histories of random batches, one change after the other; more changes than a history holds."""
    rng = random.Random(5)
    schema = "entity_id int, name string, type string, version int, aliases array<string>, valid_from timestamp, valid_to timestamp, history array<struct<snapshot:struct<version:int,name:string,type:string,valid_from:timestamp,valid_to:timestamp>,event:string>>"
    base = [(k, f"Name {k}", "OTHER", 1, [f"A{k}"], day(0), None, []) for k in range(5)]
    batch = [(n, rng.choice([0, 1, 2, 9]), rng.choice(["CHANGE", "change ", "END", None, "MOVE"]), rng.choice([None, " ", "Ada", "ADA", "Bob", "Name 1"]), rng.choice([None, "person", "odd", "place"]), day(n)) for n in range(90)]
    state = {k: {"name": nm, "type": t, "version": v, "from": f, "to": None, "history": []} for k, nm, t, v, _, f, _, _ in base}
    said = []
    for n, k, event, name, kind, eff in batch:
        event = (event or "CHANGE").strip().upper()
        said.append((n, "UNKNOWN_EVENT" if event == "MOVE" else "NOT_FOUND" if k == 9 else "APPLIED"))
        if said[-1][1] != "APPLIED":
            continue
        e = state[k]
        e["history"].append((e["version"], e["name"], e["type"], e["from"], eff, event))
        e |= {"version": e["version"] + 1, "from": eff, "to": eff if event == "END" else None}
        if event == "CHANGE":
            if (name or "").strip() and name.lower() != e["name"].lower():
                e["name"] = name
            if kind in ("person", "place"):
                e["type"] = kind.upper()
    out, outcomes = changes.evolve_entities(spark.createDataFrame(base, schema), spark.createDataFrame(batch, "ord int, entity_id int, action string, new_name string, new_type string, effective timestamp"))
    got = {r.entity_id: r for r in out.collect()}
    assert len(got) == 5 and sorted((r.ord, r.outcome) for r in outcomes.collect()) == said
    for k, e in state.items():
        r = got[k]
        assert (r.name, r.type, r.version, r.valid_from, r.valid_to) == (e["name"], e["type"], e["version"], e["from"], e["to"])
        assert [(*h.snapshot, h.event) for h in r.history] == e["history"][-20:]
        assert e["name"].lower() not in [a.lower() for a in r.aliases] and r.aliases[0] == f"A{k}"
