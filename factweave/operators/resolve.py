"""Entity resolution: blocked name comparison, matching with an ambiguity margin, the identity gate, ingest and recovery."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from factweave.functions import columns as C
from factweave.functions.canonical import op_key

#: Scores from which a name is linked, is worth a review, and leaves no doubt; the distance to the second that is too small. Fixed values.
MATCH, REVIEW, CLEAR, MARGIN = 0.82, 0.68, 0.92, 0.08


def token_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, jaccard, containment) of all pairs of names that share a core token; counted by token, so no pair is made that shares none."""
    words = lambda df, n: df.select(F.col("name").alias(n)).distinct().withColumn(f"w{n}", F.array_distinct(C.core_tokens(F.col(n))))
    a, b = words(left, "a"), words(right, "b")
    hits = a.select("a", F.size("wa").alias("na"), F.explode("wa").alias("t")).join(b.select("b", F.size("wb").alias("nb"), F.explode("wb").alias("t")), "t")
    both = hits.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return both.select("a", "b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"), (F.col("n") / F.least("na", "nb")).alias("containment"))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-match ratio of two normalised names; on blocked pairs only."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


#: Names of more core tokens or characters may be outdone by one with other tokens even where a core key decides.
PLAIN_TOKENS, PLAIN_CHARS = 12, 80


def plausible_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, jaccard, containment) of the pairs of names that can change a decision.

    Where a core key decides (the name's own stands among the entities, .98 or more), only names of the same set of tokens can be equal to it or
    better: another one has .45 + .55 * .9 at most if its tokens lie inside the name's, and differs from it by a whole token. Such names meet by their
    set of tokens; those of more than PLAIN_TOKENS tokens or PLAIN_CHARS characters, for which a token may be too little, go with the rest. The
    rest meet by each shared token, and only pairs of which the two lengths allow a ratio that matters are kept: the second best counts down
    to MARGIN under REVIEW, so .45 ratio + .55 part + .04 has to reach .60.
    """
    said = lambda df, n: df.select(F.col("name").alias(n)).distinct().withColumns({f"w{n}": F.array_sort(F.array_distinct(C.core_tokens(F.col(n)))), f"k{n}": C.core_key(F.col(n)), f"l{n}": F.length(C.identity_text(F.col(n)))})
    a, b = said(left, "a"), said(right, "b")
    held = b.where("kb <> ''").select(F.col("kb").alias("ka")).distinct().withColumn("_held", F.lit(True))
    a = a.join(held, "ka", "left").withColumn("_plain", F.coalesce("_held", F.lit(False)) & (F.size("wa") <= PLAIN_TOKENS) & (F.col("la") <= PLAIN_CHARS))
    # one join for both: the set of tokens is a word of its own, which the names to be met by it have alone and all entities have besides
    whole = lambda w: F.array(F.concat(F.lit("="), F.array_join(w, " ")))
    left = a.select("a", "la", "_plain", F.size("wa").alias("na"), F.explode(F.when(F.col("_plain"), whole("wa")).otherwise(F.col("wa"))).alias("t"))
    hits = left.join(b.select("b", "lb", F.size("wb").alias("nb"), F.explode(F.concat("wb", whole("wb"))).alias("t")), "t")
    both = hits.groupBy("a", "b").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("na", "nb", "la", "lb", "_plain")])
    one = lambda c: F.when(F.col("_plain"), 1.0).otherwise(c)
    both = both.select("a", "b", "la", "lb", "_plain", one(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"), one(F.col("n") / F.least("na", "nb")).alias("containment"))
    most = 2 * F.least("la", "lb") / (F.col("la") + F.col("lb"))
    return both.where(F.col("_plain") | (0.45 * most + 0.55 * F.greatest("jaccard", 0.9 * F.col("containment")) + 0.04 >= REVIEW - MARGIN - 1e-9)).select("a", "b", "jaccard", "containment")


def name_scores(candidates: DataFrame, entities: DataFrame, all_pairs: bool = False) -> DataFrame:
    """(a, b, score): .98 for equal core keys, else .45 ratio + .55 of the token part, for pairs of names sharing a core token.

    A pair that shares none stays under .49, below every threshold, so leaving it out changes no decision; so do those that ``plausible_pairs`` leaves
    out, unless scores are lifted afterwards: then ``all_pairs`` is asked for.
    """
    p = token_pairs(candidates, entities) if all_pairs else plausible_pairs(candidates, entities)
    part = F.greatest("jaccard", 0.9 * F.col("containment"))
    same = (C.core_key(F.col("a")) == C.core_key(F.col("b"))) & (C.core_key(F.col("a")) != "")
    ratio = sequence_ratio(C.identity_text(F.col("a")), C.identity_text(F.col("b")))
    return p.withColumn("ratio", ratio).select("a", "b", F.when(same, 0.98).otherwise(0.45 * F.col("ratio") + 0.55 * part).alias("score"))


def _kind(c: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(c)), F.lit("")), F.lit("OTHER"))


def _names(df: DataFrame) -> Column:
    """Name and aliases of an entity, blank ones dropped."""
    return C.clean_ids(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in df.columns else F.array("name"))


def resolve(candidates: DataFrame, entities: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    """Best entity of each candidate (candidate_id, name, type) by its best name or alias, and the decision.

    MATCHED from .82 unless ambiguous (best under .92 and within .08 of the second), REVIEW from .68, AMBIGUOUS from .68 without the
    margin, else NOT_FOUND. An equal known type adds .04. ``similarity`` (a, b, sim) of names lifts a score of .45 or more to
    .75 sim + .25 score. Blank names are NOT_FOUND. Ties go to the smaller entity_id.
    Equal candidates and equal entities (same names, same type) are compared once: pairs are made between classes, and only the two
    best classes of a candidate class are kept.
    """
    cand = candidates.select("candidate_id", F.coalesce(F.trim("name"), F.lit("")).alias("a"), _kind(F.col("type")).alias("ct"))
    left = cand.where("a <> ''").select("a", "ct").distinct()
    classes = entities.select("entity_id", _names(entities).alias("names"), _kind(F.col("type")).alias("et")).groupBy("names", "et").agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("n"))
    named = classes.select("entity_id", "et", "n", F.explode("names").alias("b"))
    pairs = name_scores(left.select(F.col("a").alias("name")), named.select(F.col("b").alias("name")), similarity is not None)
    if similarity is not None:
        pairs = pairs.join(similarity.select("a", "b", "sim"), ["a", "b"], "left").withColumn("score", F.when((F.col("score") >= 0.45) & F.col("sim").isNotNull(), F.greatest("score", 0.75 * F.col("sim") + 0.25 * F.col("score"))).otherwise(F.col("score"))).drop("sim")
    bonus = F.when((F.col("ct") == F.col("et")) & (F.col("ct") != "OTHER"), 0.04).otherwise(0.0)
    best = (left.join(pairs, "a").join(named, "b").groupBy("a", "ct", "entity_id", "et", "n").agg(F.max("score").alias("score"))
            .withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + bonus), 4)))
    w = Window.partitionBy("a", "ct").orderBy(F.col("score").desc(), "entity_id")
    two = best.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("a", "ct").agg(
        F.max(F.when(F.col("rn") == 1, F.struct("entity_id", "score", "n"))).alias("x"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("next"))
    second = F.when(F.col("x.n") > 1, F.col("x.score")).otherwise(F.col("next"))
    unclear = F.coalesce((F.col("x.score") < CLEAR) & (F.col("x.score") - second < MARGIN), F.lit(False))
    found = two.select("a", "ct", "x.entity_id", "x.score", unclear.alias("ambiguous"))
    decision = (F.when((F.col("score") >= MATCH) & ~F.col("ambiguous"), "MATCHED").when((F.col("score") >= REVIEW) & ~F.col("ambiguous"), "REVIEW")
                .when(F.col("score") >= REVIEW, "AMBIGUOUS").otherwise("NOT_FOUND"))
    return cand.join(found, ["a", "ct"], "left").select("candidate_id", "entity_id", "score", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), decision.alias("decision"))


#: Types of which two of one name are not taken for the same without review. Fixed values.
COLLISION_TYPES = ("PERSON", "ORGANIZATION", "PLACE")


def judge(score: Column, candidate_type: Column, entity_type: Column, ambiguous: Column, exact_name: Column, same_core: Column) -> Column:
    """SAME, POSSIBLE_CONFLICT or DIFFERENT by ordered rules."""
    return (F.when((candidate_type != entity_type) & (candidate_type != "OTHER") & (entity_type != "OTHER"), "DIFFERENT").when(ambiguous, "POSSIBLE_CONFLICT")
            .when(exact_name & (candidate_type == entity_type) & entity_type.isin(*COLLISION_TYPES), "POSSIBLE_CONFLICT")
            .when(same_core & (score >= REVIEW), "SAME").when(score >= CLEAR, "SAME").when(score >= REVIEW, "POSSIBLE_CONFLICT").otherwise("DIFFERENT"))


def gate(candidates: DataFrame, entities: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    """(candidate_id, entity_id, score, decision) of candidates with a plausible entity: the best one from .68, else the one of equal canonical name.

    decision is the identity gate's. Candidates without a plausible entity are left out.
    """
    r = resolve(candidates, entities, similarity)
    exact = entities.select("entity_id", F.explode(_names(entities)).alias("nm")).groupBy(C.canonical_name(F.col("nm")).alias("k")).agg(F.min("entity_id").alias("exact_id"))
    rows = candidates.select("candidate_id", "name", "type", C.canonical_name(F.col("name")).alias("k")).join(r.drop("decision"), "candidate_id").join(exact, "k", "left")
    rows = rows.withColumn("entity_id", F.when(F.col("score") >= REVIEW, F.col("entity_id")).otherwise(F.col("exact_id"))).where("entity_id is not null")
    seen = entities.select("entity_id", F.col("name").alias("en"), F.col("type").alias("et"), F.transform(_names(entities), C.canonical_name).alias("ks"))
    rows = rows.join(seen, "entity_id")
    core = C.gate_core(F.col("name"))
    verdict = judge(F.coalesce("score", F.lit(0.0)), _kind(F.col("type")), _kind(F.col("et")), F.col("ambiguous"), F.array_contains("ks", F.col("k")), core == C.gate_core(F.col("en")))
    return rows.select("candidate_id", "entity_id", F.coalesce("score", F.lit(0.0)).alias("score"), verdict.alias("decision"))


def recover_entities(candidates: DataFrame, archive: DataFrame, force: bool = False) -> DataFrame:
    """Log row per candidate (candidate_id, entity_id, score, decision, status): RECOVERED if the gate says SAME (or by force), BLOCKED, or NOT_FOUND.

    Only archived entities of .68 or more are tried; an equal name alone isn't enough.
    """
    tried = gate(candidates, archive).where(F.col("score") >= REVIEW)
    if force:
        tried = tried.withColumn("decision", F.lit("SAME"))
    rows = candidates.select("candidate_id").join(tried, "candidate_id", "left")
    return rows.select("candidate_id", "entity_id", "score", F.coalesce("decision", F.lit("DIFFERENT")).alias("decision"),
                       F.when(F.col("entity_id").isNull(), "NOT_FOUND").when(F.col("decision") == "SAME", "RECOVERED").otherwise("BLOCKED").alias("status"))


def ingest_entities(candidates: DataFrame, active: DataFrame, archive: DataFrame) -> DataFrame:
    """What becomes of each candidate: candidate_id, action LINK, RECOVER or CREATE, entity_id, blocked_by, score, decision.

    The active store comes first; only candidates without a plausible active entity are tried against the archive. Only SAME merges;
    a candidate blocked by the gate becomes an entity of its own and names the one it collided with in ``blocked_by``. A new id is
    derived from canonical name and type, so equal candidates of a batch become one entity and a rerun gives the same id.
    entity ids are strings.
    """
    first = gate(candidates, active)
    rest = candidates.join(first.select("candidate_id"), "candidate_id", "left_anti")
    second = recover_entities(rest, archive).where("status <> 'NOT_FOUND'")
    tried = first.select("candidate_id", "entity_id", "score", "decision", F.lit("LINK").alias("how")).unionByName(second.select("candidate_id", "entity_id", "score", "decision", F.lit("RECOVER").alias("how")))
    rows = candidates.select("candidate_id", "name", "type").join(tried, "candidate_id", "left")
    same = F.coalesce(F.col("decision") == "SAME", F.lit(False))
    own = F.concat(F.lit("ent_"), F.substring(F.sha2(F.concat_ws("|", C.canonical_name(F.col("name")), _kind(F.col("type"))), 256), 1, 12))
    return rows.where(C.norm_name(F.col("name")) != "").select(
        "candidate_id", F.when(same, F.col("how")).otherwise("CREATE").alias("action"), F.when(same, F.col("entity_id").cast("string")).otherwise(own).alias("entity_id"),
        F.when(~same, F.col("entity_id").cast("string")).alias("blocked_by"), "score", "decision")


def merge_entities(active: DataFrame, archive: DataFrame, candidates: DataFrame, plan: DataFrame, links: int = 200) -> tuple[DataFrame, DataFrame]:
    """(active, archive) after a plan of ``ingest_entities``; stores and candidates: name, type, aliases, confidence, description, memory_ids (and mention_count).

    Confidence is the highest, aliases and memory ids are united (first 20, newest ``links``), an empty description is filled, each new
    memory id is a mention. Names and mentions of a hot entity are cut to what is kept before they meet.
    """
    rows = plan.select("candidate_id", F.col("entity_id"), "action").join(candidates, "candidate_id")
    alias = rows.select("entity_id", F.explode(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))).alias("x")).groupBy("entity_id", C.canonical_name(F.col("x")).alias("k")).agg(F.min("x").alias("x"))
    alias = alias.withColumn("rn", F.row_number().over(Window.partitionBy("entity_id").orderBy("k"))).where("rn <= 21").groupBy("entity_id").agg(F.array_sort(F.collect_list("x")).alias("_aliases"))
    refs = rows.select("entity_id", F.explode("memory_ids").alias("m")).where(F.trim("m") != "").distinct()
    held = active.unionByName(archive, allowMissingColumns=True).select(F.col("entity_id").cast("string").alias("entity_id"), F.explode("memory_ids").alias("m"))
    fresh = refs.join(held, ["entity_id", "m"], "left_anti")
    counts = fresh.groupBy("entity_id").agg(F.count("*").alias("_new"))
    newest = fresh.withColumn("rn", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("m").desc()))).where(F.col("rn") <= links).groupBy("entity_id").agg(F.array_sort(F.collect_list("m")).alias("_ids"))
    merged = rows.groupBy("entity_id").agg(
        F.first("action").alias("_action"), F.max("confidence").alias("_confidence"), F.max_by("description", F.when(F.trim("description") != "", F.col("confidence"))).alias("_description"),
        F.min("name").alias("_name"), F.min(_kind(F.col("type"))).alias("_type")).join(alias, "entity_id", "left").join(counts, "entity_id", "left").join(newest, "entity_id", "left")
    cols = ["name", "type", "aliases", "confidence", "description", "memory_ids", "mention_count"]
    base = active.select(F.col("entity_id").cast("string").alias("entity_id"), *cols)
    back = archive.select(F.col("entity_id").cast("string").alias("entity_id"), *cols).join(merged.where("_action = 'RECOVER'").select("entity_id"), "entity_id", "left_semi")
    rest = archive.join(merged.where("_action = 'RECOVER'").select(F.col("entity_id").alias("_e")), F.col("entity_id").cast("string") == F.col("_e"), "left_anti")
    every = base.unionByName(back).join(merged, "entity_id", "full_outer")
    none = F.array().cast("array<string>")
    name = F.coalesce("name", "_name")
    return every.select(
        "entity_id", name.alias("name"), F.coalesce("type", "_type").alias("type"), C.clean_aliases(F.concat(F.coalesce("aliases", none), F.coalesce("_aliases", none)), name).alias("aliases"),
        F.greatest("confidence", "_confidence").alias("confidence"), F.coalesce(F.nullif(F.trim("description"), F.lit("")), "_description", F.lit("")).alias("description"),
        C.keep_newest(F.concat(F.coalesce("memory_ids", none), F.coalesce("_ids", none)), links).alias("memory_ids"), (F.coalesce("mention_count", F.lit(0)) + F.coalesce("_new", F.lit(0))).cast("long").alias("mention_count")), rest


def record_conflicts(old: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per (canonical candidate, entity): the newest analysis wins, and may open a settled record again; RESOLVED only if SAME."""
    rows = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(batch, allowMissingColumns=True).withColumn("candidate", C.canonical_name(F.col("candidate_name")))
    return rows.groupBy("candidate", "entity_id").agg(F.max_by(F.struct("candidate_name", "decision"), "seq").alias("x"), F.count("*").alias("n_analyses")).select(
        "candidate", "entity_id", "x.candidate_name", "x.decision", F.when(F.col("x.decision") == "SAME", "RESOLVED").otherwise("ACTIVE").alias("status"), "n_analyses")


def set_conflict_status(conflicts: DataFrame, changes: DataFrame) -> DataFrame:
    """Conflicts with the status (RESOLVED or DISMISSED) and reason of ``changes`` (conflict_id, status, reason); other statuses are ignored."""
    c = changes.select("conflict_id", F.upper(F.trim("status")).alias("_s"), F.substring(F.trim("reason"), 1, 1000).alias("_r")).where(F.col("_s").isin("RESOLVED", "DISMISSED"))
    c = c.groupBy("conflict_id").agg(F.max("_s").alias("_s"), F.max("_r").alias("_r"))
    return conflicts.join(c, "conflict_id", "left").withColumns({"status": F.coalesce("_s", "status"), "reason": F.coalesce("_r", "reason")}).drop("_s", "_r")


def append_log(log: DataFrame, events: DataFrame, *key: str) -> DataFrame:
    """Log with each logical event once: events already in it, and repeats inside the batch, add nothing."""
    k = lambda df: op_key(df, F.lit("LOG"), **{c: F.col(c) for c in key})
    return log.unionByName(events.withColumn("_k", k(events)).dropDuplicates(["_k"]).join(log.select(k(log).alias("_k")), "_k", "left_anti").drop("_k"), allowMissingColumns=True)


def reanalyze(conflicts: DataFrame) -> DataFrame:
    """Conflict records with the gate's decision on their stored names, types and score; ids stay, a record is RESOLVED if SAME and open again if not."""
    name = lambda c: C.canonical_name(F.col(c))
    core = C.gate_core(F.col("candidate_name")) == C.gate_core(F.col("entity_name"))
    verdict = judge(F.coalesce("score", F.lit(0.0)), _kind(F.col("candidate_type")), _kind(F.col("entity_type")), F.lit(False), name("candidate_name") == name("entity_name"), core)
    return conflicts.withColumn("decision", verdict).withColumn("status", F.when(F.col("decision") == "SAME", "RESOLVED").otherwise("ACTIVE"))


def attach_created(conflicts: DataFrame, created: DataFrame) -> DataFrame:
    """Conflicts with the entity that was created for them; created: conflict_id, created_entity_id."""
    c = created.groupBy("conflict_id").agg(F.max("created_entity_id").alias("_made"))
    return conflicts.join(c, "conflict_id", "left").withColumn("created_entity_id", F.coalesce("_made", "created_entity_id")).drop("_made")
