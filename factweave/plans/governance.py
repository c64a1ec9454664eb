"""Queries over the ledger, the journal, the audit and text curation, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import audit, curate, normalise, shapes
from factweave.operators import reconcile as rec
from factweave.plans import views as V
from factweave.streaming import ledger, schedule

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_OPS = """ops as (select case when event_id % 101 = 0 then '' else (event_id - case when event_id % 97 = 0 then 1 else 0 end)::varchar end as operation_id, sha256(user_id || '|' || event_type || '|' || props) as operation_key,
  case when event_id % 89 = 0 then 'ODD' when event_type = 'error' then 'FAILED' when event_type = 'purchase' then 'COMPLETED' else 'STARTED' end as status,
  (event_id % 7)::int as attempt_count, (event_id % 5)::int as recovery_count, case when event_id % 3 = 0 then ts::timestamp end as lease from events)"""


def ops(spark, sf):
    e = V.table(spark, sf, "events")
    near = F.col("event_id") - F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)
    return e.select(
        F.when(F.col("event_id") % 101 == 0, "").otherwise(near.cast("string")).alias("operation_id"), F.sha2(F.concat_ws("|", "user_id", "event_type", "props"), 256).alias("operation_key"),
        F.when(F.col("event_id") % 89 == 0, "ODD").when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "COMPLETED").otherwise("STARTED").alias("status"),
        (F.col("event_id") % 7).cast("int").alias("attempt_count"), (F.col("event_id") % 5).cast("int").alias("recovery_count"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("lease_expires_at"))


_AUDIT_OPS = f"""with {_OPS}, g as (select * from ops where operation_id <> '')
select 'OPERATION_MISSING_ID' as code, operation_id as key, 1::bigint as n from ops where operation_id = ''
union all select 'OPERATION_INVALID_STATUS', operation_id, 1 from g where status = 'ODD'
union all select 'OPERATION_INVALID_ATTEMPT_COUNT', operation_id, 1 from g where attempt_count < 1
union all select 'OPERATION_INVALID_RECOVERY_COUNT', operation_id, 1 from g where recovery_count > 3
union all select 'COMPLETED_OPERATION_HAS_LEASE', operation_id, 1 from g where status = 'COMPLETED' and lease is not null
union all select 'OPERATION_DUPLICATE_ID', operation_id, count(*) - 1 from g group by 2 having count(*) > 1
union all select 'OPERATION_DUPLICATE_KEY', operation_key, count(*) - 1 from g group by 2 having count(*) > 1"""


@query("audit_operations", _AUDIT_OPS)
def audit_operations(spark, sf):
    return audit.audit_operations(ops(spark, sf))


@query("classify", f"select code, sum(n)::bigint as n, code = 'COMPLETED_OPERATION_HAS_LEASE' as repairable from ({_AUDIT_OPS}) group by 1")
def classify(spark, sf):
    return audit.classify(audit.audit_operations(ops(spark, sf)))


@query("policy", f"""with v as (select code, sum(n)::bigint as n from ({_AUDIT_OPS}) group by 1)
select code, n, case when code = 'COMPLETED_OPERATION_HAS_LEASE' then 'AUTO' when code like 'OPERATION_INVALID%' then 'DRY_RUN_ONLY' else 'BLOCKED' end as action, 'BLOCKED' as effective from v""")
def policy(spark, sf):
    rules = {"COMPLETED_OPERATION_HAS_LEASE": "AUTO"} | {f"OPERATION_INVALID_{x}": "DRY_RUN_ONLY" for x in ("STATUS", "ATTEMPT_COUNT", "RECOVERY_COUNT")}
    return audit.evaluate_policy(audit.audit_operations(ops(spark, sf)), rules)


_STORES = """a as (select case when o_orderkey % 113 = 0 then null else o_orderkey end as memory_id, case when o_orderkey % 61 = 0 then 'archived' else 'active' end as status,
  case when o_orderkey % 31 = 0 then o_orderkey + 1000000 else null end as supersedes, case when o_orderkey % 37 = 0 then o_orderkey else null end as superseded_by from orders where o_orderkey % 5 <> 0 or o_orderkey % 55 = 0),
r as (select o_orderkey as memory_id, case when o_orderkey % 71 = 0 then 'active' else 'archived' end as status, null::bigint as supersedes, null::bigint as superseded_by from orders where o_orderkey % 5 = 0)"""


def stores(spark, sf):
    k = F.col("o_orderkey")
    o = V.table(spark, sf, "orders")
    a = o.where((k % 5 != 0) | (k % 55 == 0)).select(F.when(k % 113 != 0, k).alias("memory_id"), F.when(k % 61 == 0, "archived").otherwise("active").alias("status"), F.when(k % 31 == 0, k + 1000000).alias("supersedes"), F.when(k % 37 == 0, k).alias("superseded_by"))
    none = F.lit(None).cast("long")
    return a, o.where(k % 5 == 0).select(k.alias("memory_id"), F.when(k % 71 == 0, "active").otherwise("archived").alias("status"), none.alias("supersedes"), none.alias("superseded_by"))


@query("audit_items", f"""with {_STORES}, e as (select memory_id from a union all select memory_id from r)
select 'MEMORY_MISSING_ID' as code, memory_id::varchar as key, 1::bigint as n from a where memory_id is null
union all select 'ACTIVE_MEMORY_MARKED_ARCHIVED', memory_id::varchar, 1 from a where memory_id is not null and status = 'archived'
union all select 'MEMORY_ARCHIVE_STATUS_INVALID', memory_id::varchar, 1 from r where status <> 'archived'
union all select 'MEMORY_ACTIVE_ARCHIVE_OVERLAP', memory_id::varchar, 1 from a where memory_id in (select memory_id from r)
union all select 'MEMORY_SUPERSEDES_REFERENCE_MISSING', memory_id::varchar, count(*) from a where supersedes is not null and not exists (select 1 from e where e.memory_id = supersedes) group by 2
union all select 'MEMORY_SUPERSEDED_BY_REFERENCE_MISSING', memory_id::varchar, count(*) from a where superseded_by is not null and not exists (select 1 from e where e.memory_id = superseded_by) group by 2""")
def audit_items(spark, sf):
    return audit.audit_items(*stores(spark, sf))


_LINKS = """l as (select l_partkey as entity_id, l_linenumber + l_orderkey * 10 as ord, case when l_orderkey % 13 = 0 then '' when l_orderkey % 17 = 0 then 'm-' || l_orderkey else 'm' || (l_orderkey % 40) end as ref from lineitem),
known as (select distinct 'm' || (o_orderkey % 40) as ref from orders)"""


def links(spark, sf):
    k = F.col("l_orderkey")
    ref = F.when(k % 13 == 0, "").when(k % 17 == 0, F.concat(F.lit("m-"), k)).otherwise(F.concat(F.lit("m"), k % 40))
    e = V.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("entity_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct((F.col("l_linenumber") + k * 10).alias("o"), ref.alias("r")))), lambda x: x["r"]).alias("memory_ids"))
    return e, V.table(spark, sf, "orders").select(F.concat(F.lit("m"), F.col("o_orderkey") % 40).alias("memory_id")).distinct()


@query("audit_links", f"""with {_LINKS} select 'ENTITY_EMPTY_MEMORY_LINK' as code, entity_id::varchar as key, count(*) as n from l where ref = '' group by 2
union all select 'ENTITY_DUPLICATE_MEMORY_LINK', entity_id::varchar, sum(n)::bigint from (select entity_id, ref, count(*) - 1 as n from l where ref <> '' group by 1, 2 having count(*) > 1) group by 2
union all select 'ENTITY_MEMORY_REFERENCE_MISSING', entity_id::varchar, count(distinct ref) from l where ref <> '' and ref not in (select ref from known) group by 2""")
def audit_links(spark, sf):
    return audit.audit_links(*links(spark, sf))


@query("repair_links", f"""with {_LINKS}, f as (select entity_id, ref, min(ord) as o from l where ref in (select ref from known) group by 1, 2), n as (select entity_id, count(*) as n from l group by 1)
select entity_id, coalesce(string_agg(ref, ',' order by o), '') as memory_ids, (any_value(n.n) - count(ref))::bigint as removed from n left join f using (entity_id) group by 1""")
def repair_links(spark, sf):
    return audit.repair_links(*links(spark, sf)).withColumn("memory_ids", F.array_join("memory_ids", ","))


@query("table_diff", """select o_orderkey, 'o_totalprice' as field, 'value_changed' as change from orders where o_orderkey % 10 = 1 union all select o_orderkey, '*', 'removed' from orders where o_orderkey % 10 = 2
union all select -o_orderkey, '*', 'added' from orders where o_orderkey % 10 = 3""")
def table_diff(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey")
    after = o.where(k % 10 != 2).withColumn("o_totalprice", F.when(k % 10 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return audit.table_diff(o, after.unionByName(o.where(k % 10 == 3).withColumn("o_orderkey", -k)), "o_orderkey").select("o_orderkey", "field", "change")


@query("ledger_once", f"with {_OPS} select operation_key, count(*) as n_seen from ops group by 1")
def ledger_once(spark, sf):
    return ledger.once(ops(spark, sf).withColumn("ord", F.lit(1)), "operation_key", "ord").select("operation_key", "n_seen")


_J = "j as (select event_id as sequence, sha256(event_id || '|' || case when event_id % 500 = 7 then 'changed' else event_type end) as now_hash, sha256(event_id || '|' || event_type) as record_hash from events)"


def journal(spark, sf):
    e = V.table(spark, sf, "events")
    text = lambda c: F.sha2(F.concat_ws("|", "event_id", c), 256)
    kept = e.select("event_id", F.col("event_type"), text(F.col("event_type")).alias("record_hash"))
    prev = kept.select((F.col("event_id") + 1).alias("event_id"), F.col("record_hash").alias("previous_record_hash"))
    told = F.when(F.col("event_id") % 500 == 7, "changed").otherwise(F.col("event_type"))
    return kept.join(prev, "event_id", "left").select(F.col("event_id").alias("sequence"), text(told).alias("content_hash"), "record_hash",
                                                     F.when(F.col("event_id") % 700 == 9, "broken").otherwise(F.col("previous_record_hash")).alias("previous_record_hash"))


@query("hash_chain", f"""with {_J}, p as (select sequence, now_hash, record_hash, lag(record_hash) over (order by sequence) as prev, case when sequence % 700 = 9 then 'broken' else lag(record_hash) over (order by sequence) end as said from j)
select sequence, case when now_hash <> record_hash then 'CONTENT_HASH_MISMATCH' else 'CHAIN_BROKEN' end as reason from p where now_hash <> record_hash or (said is distinct from prev)""")
def hash_chain(spark, sf):
    return ledger.verify_chain(journal(spark, sf))


@query("journal_compact", "select (select max(event_id) from events) - 100 as checkpoint, count(*) as tail from events where event_id > (select max(event_id) from events) - 100")
def journal_compact(spark, sf):
    return ledger.compact(V.table(spark, sf, "events").select(F.col("event_id").alias("sequence")), 100)


@query("lease_states", f"""select event_id, case when event_type = 'error' then 'FAILED' when event_type = 'purchase' then 'COMPLETED' when ts::timestamp + interval 120 second <= timestamp '2024-01-20' then 'STALE' else 'STARTED' end as state from events""")
def lease_states(spark, sf):
    e = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "COMPLETED").otherwise("STARTED")
    return ledger.lease_state(e.withColumns({"status": status, "lease": F.col("ts") + F.expr("interval 120 seconds"), "started": F.col("ts")}), V.now("2024-01-20")).select("event_id", "state")


@query("interval_gate", """with recursive r as (select user_id, epoch_us(ts::timestamp) as t, row_number() over (partition by user_id order by ts) as i from (select distinct user_id, ts from events)),
f as (select user_id, i, t, t as last, true as keep from r where i = 1
union all select f.user_id, r.i, r.t, case when r.t - f.last >= 21600000000 then r.t else f.last end, r.t - f.last >= 21600000000 from f join r on r.user_id = f.user_id and r.i = f.i + 1)
select user_id, t as ts from f where keep""")
def interval_gate(spark, sf):
    return ledger.one_per_interval(V.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 6 * 3600).select("user_id", F.unix_micros("ts").alias("ts"))


#: Kinds of the planted schedule by type and number of an event.
_POST_KIND = """case event_type when 'error' then case event_id % 2 when 0 then 'TICK_FAILS' else 'TICK_UNSEEN' end when 'signup' then case when event_id % 4 = 0 then 'PAUSE' else 'RESUME' end
when 'purchase' then case event_id % 3 when 0 then 'SKIP' else 'APPROVE' end else 'TICK' end"""


@query("post_schedule", f"""with recursive e as (select m.review, user_id as k, epoch_us(ts::timestamp) as at_us, {_POST_KIND} as kind from events, (values (false), (true)) m(review)),
o as (select *, row_number() over (partition by review, k order by at_us, kind) as i from e), lim as (select 86400000000 as step, 43200000000 as wait),
r as (select review, k, 0::bigint as i, min(at_us) as last, null::bigint as retry, null::bigint as draft, false as paused, 0 as done, null::bigint as at_us, null::varchar as kind, null::varchar as outcome from e group by review, k
  union all select review, k, i, case when outcome in ('POSTED', 'SKIPPED') then at_us else last end, case when outcome = 'FAILED' then at_us + wait else retry end,
    case when outcome = 'DRAFTED' then at_us when outcome in ('POSTED', 'SKIPPED') or (outcome = 'FAILED' and kind = 'TICK_UNSEEN') then null else draft end,
    case outcome when 'PAUSED' then true when 'RESUMED' then false else paused end, done + case when outcome in ('POSTED', 'SKIPPED') then 1 else 0 end, at_us, kind, outcome
  from (select r.review, r.k, o.i, r.last, r.retry, r.draft, r.paused, r.done, o.at_us, o.kind, step, wait,
      case when o.kind = 'PAUSE' then 'PAUSED' when o.kind = 'RESUME' then 'RESUMED' when o.kind in ('APPROVE', 'SKIP') then case when r.draft is null then 'IGNORED' when o.kind = 'SKIP' then 'SKIPPED' else 'POSTED' end
        when r.paused then 'HELD' when o.at_us < r.retry then 'RETRY_WAIT' when r.review and r.draft is not null and o.at_us - r.draft < step then 'DRAFT_WAITS'
        when (not r.review or r.draft is null) and o.at_us - r.last < step then 'NOT_DUE' when o.kind <> 'TICK' then 'FAILED' when r.review then 'DRAFTED' else 'POSTED' end as outcome
    from r join o on o.review = r.review and o.k = r.k and o.i = r.i + 1, lim))
select review, k as user_id, at_us, kind, outcome, done as n_done, draft is not null as waiting, paused from r where i > 0""")
def post_schedule(spark, sf):
    """Each user's events as ticks, failures, pauses and verdicts: one output a day, half a day of rest after a failure, with and without review."""
    e = V.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(_POST_KIND).alias("kind"))
    both = [schedule.post_batch(e, "user_id", 86400, 43200, review).withColumn("review", F.lit(review)) for review in (False, True)]
    return both[0].unionByName(both[1]).select("review", "user_id", F.unix_micros("ts").alias("at_us"), "kind", "outcome", "n_done", "waiting", "paused")


@query("secret_filter", r"select doc_id from documents where regexp_matches(text, '(?i)(password|passwd|api[_ -]?key|secret|token)\s*(is|:|=)|sk-[A-Za-z0-9]{10,}')")
def secret_filter(spark, sf):
    return V.table(spark, sf, "documents").where(curate.has_secret(F.col("text"))).select("doc_id")


@query("clean_post", r"""select doc_id, t as text from (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '\*\*|__|`', '', 'g'), '(?m)^\s{0,3}#{1,6}\s*', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as t from documents)
where length(t) between 60 and 3500 and not regexp_matches(lower(t), '^\s*(sorry|i can''t|i cannot|i''m sorry|as an ai)')""")
def clean_post(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", curate.strip_markup(F.col("text")).alias("text"))
    return d.where(curate.accepted(F.col("text")))


_SECRET_SQL = r"(?i)(password|passwd|api[_ -]?key|secret|token)\s*(is|:|=)|sk-[A-Za-z0-9]{10,}"


@query("facts", rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where doc_id % 3 <> 2),
t as (select doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') as memory from l), g as (select * from t where memory <> '' and length(memory) <= 300 and not regexp_matches(memory, '{_SECRET_SQL}'))
select doc_id, memory, 'other' as type, 4 as importance from (select *, row_number() over (partition by doc_id order by pos) as n from g) where n <= 3""")
def facts(spark, sf):
    """Every line of a document as a fact of a reply; replies come bare, inside prose, or broken."""
    d = V.table(spark, sf, "documents")
    good = F.to_json(F.struct(F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), F.lit("4").alias("importance"))).alias("facts")))
    raw = F.when(F.col("doc_id") % 3 == 0, good).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Here: "), good, F.lit(" done"))).otherwise("{broken")
    return curate.fact_rows(d.select("doc_id", raw.alias("raw")), "raw", "doc_id")


_TAGS_SQL = "['details', 'summary', 'blockquote', 'sub', 'sup', 'u']"


@query("rich_post", r"""with p as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents),
f as (select doc_id, regexp_replace(t, '(?s)^```(?:markdown|md)?\s*\n(.*)\n```$', '\1', 'g') as t from p),
l as (select doc_id, regexp_replace(regexp_replace(t, '\[([^\]]*)\]\(https?://[^)]*\)', '\1', 'g'), 'https?://\S+', '', 'g') as t from f),
r as (select row_number() over () as id, doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as t from l),
m as (select *, regexp_replace(t, '(?s)\$\$.*?\$\$|\$[^$\n]+\$', 'M', 'g') as flat from r where length(t) between 60 and 6000 and not regexp_matches(t, '(?i)^\s*(sorry|i can''t|i cannot|i''m sorry|as an ai)')),
g as (select *, list_transform(regexp_extract_all(flat, '</?[a-zA-Z][\w-]*[^>]*>'), lambda x: lower(regexp_extract(x, '^<(/?[a-zA-Z][\w-]*)', 1))) as tags from m where not contains(flat, '$')),
k as (select id, doc_id, t, regexp_split_to_array(t, '\r?\n') as ls from g where len(list_filter(tags, lambda x: not list_contains(""" + _TAGS_SQL + r""", ltrim(x, '/')))) = 0
  and len(list_filter(""" + _TAGS_SQL + r""", lambda a: len(list_filter(tags, lambda x: x = a)) <> len(list_filter(tags, lambda x: x = '/' || a)))) = 0),
u as (select id, pos, trim(x) as x from (select id, unnest(ls) as x, generate_subscripts(ls, 1) as pos from k) where starts_with(trim(x), '|')),
v as (select id, pos - row_number() over (partition by id order by pos) as run, pos, len(string_split(trim(x, '|'), '|')) as n, regexp_matches(x, '^\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?$') as mark from u),
y as (select id, run, n, mark, row_number() over (partition by id, run order by pos) as i, first_value(n) over (partition by id, run order by pos) as cols, count(*) over (partition by id, run) as size from v),
bad as (select distinct id from y where size = 1 or n <> cols or cols > 6 or (i = 2 and not mark))
select doc_id, t as text from k where id not in (select id from bad)""")
def rich_post(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", curate.rich_text(F.col("text")).alias("text"))
    return d.where(curate.rich_accepted(F.col("text")))


@query("reconcile", f"""with b as (select code, sum(n)::bigint as before from (select * from ({_AUDIT_OPS}) union all select * from ({ORACLE['audit_items']})) group by 1)
select code, before, case when code in ('COMPLETED_OPERATION_HAS_LEASE', 'MEMORY_ARCHIVE_STATUS_INVALID') then 0 else before end as after from b""")
def reconcile(spark, sf):
    """Ledger and fact stores after a reconciliation: violations of each code before and after it."""
    active, archive = stores(spark, sf)
    done = rec.reconcile({"operations": ops(spark, sf), "items": active, "item_archive": archive})
    return rec.compare(done.before, done.after)


@query("audit_shapes", """with e as (select event_id as key, case when event_id % 20 = 0 then '[' || props || ']' when event_id % 20 = 1 then '"x"' when event_id % 20 = 2 then '{broken' when event_id % 20 = 3 then null else props end as j from events)
select 'OPERATION_INVALID_RECORD' as code, key::varchar as key, 1::bigint as n from e where j is null or not json_valid(j) or json_type(j) <> 'OBJECT'""")
def audit_shapes(spark, sf):
    m = F.col("event_id") % 20
    j = F.when(m == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(m == 1, '"x"').when(m == 2, "{broken").when(m != 3, F.col("props"))
    return shapes.audit_records(V.table(spark, sf, "events").select("event_id", j.alias("j")), "event_id", "j", "OPERATION_INVALID_RECORD")


@query("normalize_items", """select 'o' || o_orderkey as memory_id, case when o_orderkey % 9 = 0 then 1 else 6 - substr(o_orderpriority, 1, 1)::int end as importance,
  case when o_orderkey % 9 = 0 then 0.7::double when o_orderkey % 4 = 0 then 0.99::double when 6 - substr(o_orderpriority, 1, 1)::int >= 4 then 0.9::double when 6 - substr(o_orderpriority, 1, 1)::int >= 3 then 0.8::double else 0.7::double end as confidence,
  case when o_orderkey % 9 <> 0 and 6 - substr(o_orderpriority, 1, 1)::int >= 4 then 'active' when d < 30 then 'active' when d < 90 then 'aging' else 'decaying' end as status, epoch_us(o_orderdate::timestamp) as created_at
from (select *, (epoch_us(timestamp '2001-08-02') - epoch_us(o_orderdate::timestamp)) / 86400000000.0::double as d from orders) where o_orderkey % 13 <> 0""")
def normalize_items(spark, sf):
    k = F.col("o_orderkey")
    loose = V.table(spark, sf, "orders").select(
        F.when(k % 13 == 0, "  ").otherwise(F.concat(F.lit(" order "), k)).alias("memory"), F.concat(F.lit("o"), k).alias("memory_id"), F.when(k % 9 == 0, "high").otherwise((6 - F.substring("o_orderpriority", 1, 1).cast("int")).cast("string")).alias("importance"),
        F.when((k % 4 == 0) & (k % 9 != 0), "7.5").alias("confidence"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), F.lit("odd").alias("status"))
    return normalise.normalize_items(loose, V.now()).select("memory_id", "importance", "confidence", "status", F.unix_micros("created_at").alias("created_at"))
