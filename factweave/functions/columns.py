"""Scalar rules as Column functions: coercion of loose fields, scores and keys. `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabularies and other names of types and relations.
MEMORY_TYPES = ("preference", "fact", "goal", "project", "person", "other")
REWRITE_TYPES = ("identity", "skill", "learning", "goal", "project", "preference", "tool", "constraint", "other")
TEMPORAL_STATUSES = ("current", "historical", "ended")
TEMPORAL_EVENTS = ("START", "CHANGE", "END", "NONE")
CAUSAL_RELATIONS = ("CAUSES", "RESULTS_IN", "REQUIRES", "PREVENTS")
ENTITY_TYPES = ("PERSON", "SOFTWARE", "PROJECT", "SKILL", "TECHNOLOGY", "ORGANIZATION", "PLACE", "GOAL", "DOMAIN", "PRODUCT", "OTHER")
ENTITY_ALIASES = {"APP": "SOFTWARE", "APPLICATION": "SOFTWARE", "TOOL": "SOFTWARE", "PROGRAM": "SOFTWARE", "TECH": "TECHNOLOGY", "COMPANY": "ORGANIZATION", "ORG": "ORGANIZATION", "OBJECTIVE": "GOAL", "SPECIALIZATION": "DOMAIN"}
RELATIONS = ("RELATED_TO", "USED_FOR", "WORKS_WITH", "PART_OF", "REQUIRES", "DEPENDS_ON", "LEADS_TO", "SUPPORTS", "LEARNS", "BUILDS", "APPLIES_TO")
UNDIRECTED_RELATIONS = ("RELATED_TO", "WORKS_WITH")
RELATION_ALIASES = {"RELATES_TO": "RELATED_TO", "RELATED": "RELATED_TO", "USE_FOR": "USED_FOR", "WORKS_WITH": "WORKS_WITH", "DEPENDENT_ON": "DEPENDS_ON", "RESULTS_IN": "LEADS_TO", "LEAD_TO": "LEADS_TO", "APPLY_TO": "APPLIES_TO"}
LIFECYCLES = ("ACTIVE", "AGING", "DORMANT", "ENDED")
DAY_MICROS = 86_400_000_000


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def clamp_importance(c: Column, low: int = 1, default: int = 1) -> Column:
    """Whole number in [low, 5]; what isn't one is the default (text like '4.7' too)."""
    return F.greatest(F.lit(low), F.least(F.lit(5), F.coalesce(c.try_cast("int"), F.lit(default))))


def clamp_confidence(c: Column, low: float = 0.2, high: float = 0.99, default: float = 0.8) -> Column:
    """Facts: .2 to .99, default .8. Entities and relations: ``clamp_confidence(c, 0.0, 1.0, 0.7)``."""
    return F.round(F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c.try_cast("double"), F.lit(default)))), 4)


def initial_confidence(importance: Column) -> Column:
    return F.when(importance >= 4, 0.9).when(importance >= 3, 0.8).otherwise(0.7)


def effective_confidence(confidence: Column, n_sources: Column) -> Column:
    return clamp_confidence(confidence + F.least(F.lit(0.06), 0.01 * n_sources))


def norm_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def canonical_name(c: Column) -> Column:
    """Case-folded name: the small form of the capital, so that ligatures and letters with several small forms agree; the dotless i stays one of its own."""
    kept = F.replace(norm_name(c), F.lit("ı"), F.lit("\ue000"))
    return F.replace(F.lower(F.replace(F.upper(kept), F.lit("\ue000"), F.lit("ı"))), F.lit("ς"), F.lit("σ"))


def norm_entity_type(c: Column) -> Column:
    up = F.replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), F.lit("-"), F.lit("_"))
    named = F.coalesce(F.element_at(_map(ENTITY_ALIASES), up), up)
    return F.when(named.isin(*ENTITY_TYPES), named).otherwise("OTHER")


def canonical_relation(c: Column) -> Column:
    up = F.translate(F.upper(F.trim(F.coalesce(c, F.lit("")))), "- ", "__")
    return F.coalesce(F.element_at(_map(RELATION_ALIASES), up), up)


def norm_enum(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    up = F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), r"\s+", "_")
    return F.when(up.isin(*allowed), up).otherwise(default)


#: Keywords of types, tried in this order. Fixed values.
TYPE_KEYWORDS = {
    "learning": ("learn", "یادگیری", "یاد می‌گیر", "یاد میگیر"),
    "tool": ("use solidworks", "uses solidworks", "use abaqus", "uses abaqus", "software"),
    "goal": ("goal", "هدف"),
    "project": ("project", "پروژه"),
}


def guess_type(text: Column) -> Column:
    """Ordered keyword rules; null is other."""
    low, out = F.lower(text), None
    for kind, words in TYPE_KEYWORDS.items():
        hit = F.coalesce(low.rlike("|".join(words)), F.lit(False))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def clean_ids(arr: Column, cap: int | None = None) -> Column:
    """Trimmed, non-empty, first occurrences in order, at most ``cap``."""
    kept = F.array_distinct(F.filter(F.transform(F.coalesce(arr, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.slice(kept, 1, cap) if cap else kept


def clean_aliases(arr: Column, own_name: Column, cap: int = 20) -> Column:
    """Aliases without the own name, one per case-folded form, first ``cap``."""
    names = F.transform(clean_ids(arr), norm_name)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array(canonical_name(own_name)).alias("seen"))
    step = lambda acc, x: F.when(F.array_contains(acc["seen"], canonical_name(x)), acc).otherwise(
        F.struct(F.array_append(acc["out"], x).alias("out"), F.array_append(acc["seen"], canonical_name(x)).alias("seen")))
    return F.slice(F.aggregate(names, start, step, lambda acc: acc["out"]), 1, cap)


def keep_newest(arr: Column, n: int) -> Column:
    """Last ``n`` elements of a log column."""
    return F.slice(arr, F.greatest(F.size(arr) - (n - 1), F.lit(1)), F.lit(n))


def norm_provenance(arr: Column, cap: int = 20) -> Column:
    """Log entries with a text of at most 500 characters, newest ``cap``."""
    return keep_newest(F.transform(F.filter(F.coalesce(arr, F.array().cast("array<struct<timestamp:string,action:string,event:string,reason:string,source_text:string,related_memory_ids:array<string>>>")), lambda x: x.isNotNull()),
        lambda x: x.withField("source_text", F.substring(F.coalesce(x["source_text"], F.lit("")), 1, 500)).withField("related_memory_ids", clean_ids(x["related_memory_ids"]))), cap)


def append_provenance(arr: Column, entry: Column, cap: int = 20) -> Column:
    return keep_newest(F.array_append(arr, entry), cap)


def norm_causal(arr: Column, least: float = 0.7, cap: int = 30) -> Column:
    """Causal links with a known relation and enough confidence (clamped to 0..1), newest ``cap``."""
    sure = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x["confidence"].try_cast("double"), F.lit(0.0)))), 4)
    good = F.filter(arr, lambda x: norm_enum(x["relation"], CAUSAL_RELATIONS, "").isin(*CAUSAL_RELATIONS) & (sure(x) >= least) & (F.trim(x["target_memory_id"]) != ""))
    return keep_newest(F.transform(good, lambda x: x.withField("relation", norm_enum(x["relation"], CAUSAL_RELATIONS, "")).withField("confidence", sure(x))), cap)


def parse_ts(c: Column) -> Column:
    """ISO time or date; no zone means the session's (UTC); null if it is neither."""
    return F.coalesce(F.try_to_timestamp(F.trim(c)), F.try_to_timestamp(F.trim(c), F.lit("yyyy-MM-dd")))


def age_days(ts: Column, now: Column, missing: float = 0.0) -> Column:
    """Days since ``ts``, 0 at least; a missing time is young (0) for facts and old (infinity) for entities."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(float(DAY_MICROS))
    return F.when(days.isNull(), F.lit(missing)).otherwise(F.greatest(F.lit(0.0), days))


def reinforcement(n: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("double")) / F.log(F.lit(21.0)))


def recency(days: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + F.log1p(days))))


def exp_recency(days: Column) -> Column:
    return F.exp(-days / 30)


def ratio_cap(v: Column, top: float) -> Column:
    return F.least(v / F.lit(top), F.lit(1.0))


def word_set(c: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda x: x != ""))


#: Generic words of names, words that are generic only beside others, and spellings taken for one another (in this order). Fixed values.
GENERIC_WORDS = ("software", "tool", "app", "application", "program", "fea", "cae", "platform", "system", "نرم", "افزار", "نرم_افزار")
GENERIC_BESIDE_OTHERS = ("finite", "element", "analysis")
GATE_GENERIC_WORDS = ("software", "tool", "app", "application", "program", "platform", "system", "fea", "cae", "language", "programming", "programming_language")
SPELLINGS = {
    "آباکوس": "abaqus", "آباكوس": "abaqus", "سالیدورکس": "solidworks", "سالیدورك": "solidworks", "پایتون": "python", "نرم افزار": "نرم_افزار", "نرم‌افزار": "نرم_افزار",
    "ي": "ی", "ى": "ی", "ك": "ک", "ۀ": "ه", "ة": "ه", "أ": "ا", "إ": "ا", "آ": "ا",
}
PUNCTUATION = "[()\\[\\]{}<>:;,.!?/'\\\\\"`~@#$%^&*+=|_-]+"


def identity_text(c: Column) -> Column:
    """Case-folded name with one spelling for variants and without punctuation."""
    text = canonical_name(c)
    for old, new in SPELLINGS.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(F.regexp_replace(text, PUNCTUATION, " "), r"\s+", " "))


def core_tokens(c: Column) -> Column:
    """Identity words of a name in order, generic ones dropped."""
    words = F.filter(F.split(identity_text(c), " "), lambda x: x != "")
    return F.filter(words, lambda x: ~x.isin(*GENERIC_WORDS) & ~(x.isin(*GENERIC_BESIDE_OTHERS) & (F.size(words) > 1)))


def gate_core(c: Column) -> Column:
    """Core name as the identity gate sees it: hyphens split words, its own generic words go."""
    return F.array_join(F.filter(F.split(F.replace(canonical_name(c), F.lit("-"), F.lit(" ")), r"\s+"), lambda x: (x != "") & ~x.isin(*GATE_GENERIC_WORDS)), " ")


def core_key(c: Column) -> Column:
    return F.array_join(core_tokens(c), " ")


def relation_id(source: Column, target: Column, relation: Column) -> Column:
    return F.concat(F.lit("rel_"), F.substring(F.sha2(F.concat_ws("|", source, target, relation), 256), 1, 16))


def result_ref(json: Column) -> Column:
    """First non-empty id field of a stored result."""
    fields = ("entity_id", "memory_id", "conflict_id", "relation_id", "recovery_id")
    return F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{f}"), F.lit("")) for f in fields])


def item_lifecycle(importance: Column, days: Column) -> Column:
    """active under 30 days or from importance 4, aging under 90, else decaying."""
    return F.when((importance >= 4) | (days < 30), "active").when(days < 90, "aging").otherwise("decaying")


def item_lifecycle_score(importance: Column, days: Column, access: Column) -> Column:
    band = item_lifecycle(importance, days)
    base = F.when(band == "active", 1.0).when(band == "aging", 0.65).otherwise(0.3)
    return 0.5 * base + 0.3 * importance / 5 + 0.2 * reinforcement(access)


def archive_score(importance: Column, days: Column, access: Column, band: Column | None = None) -> Column:
    """Pressure to archive: age, low importance, disuse (ten uses protect fully) and lifecycle."""
    band = item_lifecycle(importance, days) if band is None else band
    pressure = F.when(band == "decaying", 1.0).when(band == "aging", 0.45).otherwise(0.0)
    return 0.35 * ratio_cap(days, 180.0) + 0.30 * (5 - importance) / 4 + 0.15 * (1 - ratio_cap(access, 10.0)) + 0.20 * pressure


def archive_eligible(importance: Column, days: Column, access: Column) -> Column:
    return (importance <= 3) & (access <= 3) & (item_lifecycle(importance, days) == "decaying") & (days >= 180)


def entity_lifecycle(days: Column, ended: Column) -> Column:
    """Closed bands: 30 days is still active, 90 still aging; a missing time (infinite days) is dormant."""
    return F.when(ended, "ENDED").when(days <= 30, "ACTIVE").when(days <= 90, "AGING").otherwise("DORMANT")


def entity_lifecycle_score(days: Column, mentions: Column, confidence: Column, ended: Column) -> Column:
    score = 0.55 * recency(days) + 0.30 * reinforcement(mentions) + 0.15 * confidence
    return F.when(ended, 0.2).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(1.0), score)))


def is_stale(status: Column, lease: Column, started: Column, now: Column) -> Column:
    """STARTED with a lease that is over, or without a lease for 120 seconds or an unknown time."""
    no_lease = F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(started.cast("timestamp")) >= 120_000_000, F.lit(True))
    return (status == "STARTED") & F.when(lease.isNotNull(), lease.cast("timestamp") <= now.cast("timestamp")).otherwise(no_lease)
