"""Audit of approvals for repair plans."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Requirement(NamedTuple):
    """What a policy asks of an approval beyond its being granted and in time."""

    need_requester: bool = False
    no_requester: bool = False
    no_requester_role: bool = False
    allowed_roles: tuple[str, ...] = ()
    need_role: bool = False
    delegation: bool = False
    need_reference: bool = False


def bound_to(approvals: DataFrame, plans: DataFrame, need: Requirement) -> DataFrame:
    """approvals with ``code``, the first rule in order by which one isn't bound to its plan's policy, cycle, requester, role or delegator; null if it holds.

    approvals: plan_id, actor, role, requester, requester_role, policy_version, policy_fingerprint, plan_fingerprint, previous_id,
    previous_key, delegated_by, delegation_reference. plans: plan_id (one row each) and the five columns from policy_version to
    previous_key. Blank and null are the same for names; an approval of an unknown plan is held against nulls.
    """
    bound = {"policy_version": "POLICY_VERSION_MISMATCH", "policy_fingerprint": "POLICY_FINGERPRINT_MISMATCH", "plan_fingerprint": "REPAIR_PLAN_MISMATCH", "previous_id": "CYCLE_MISMATCH", "previous_key": "CYCLE_KEY_MISMATCH"}
    j = approvals.join(plans.select("plan_id", *[F.col(c).alias(f"_{c}") for c in bound]), "plan_id", "left")
    said = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    actor, role, asker, asker_role, giver = said("actor"), said("role"), said("requester"), said("requester_role"), said("delegated_by")
    roles = list(need.allowed_roles)
    rules = [(code, ~F.col(c).eqNullSafe(F.col(f"_{c}"))) for c, code in bound.items()]
    rules += [("REQUESTER_REQUIRED", asker == "")] if need.need_requester else []
    rules += [("REQUESTER_APPROVAL_FORBIDDEN", (asker != "") & (actor == asker))] if need.no_requester else []
    rules += [("REQUESTER_ROLE_REQUIRED", asker_role == ""), ("REQUESTER_ROLE_FORBIDDEN", role == asker_role)] if need.no_requester_role else []
    rules += [("ROLE_REQUIRED", role == "")] if roles or need.need_role else []
    rules += [("ROLE_NOT_ALLOWED", ~role.isin(roles))] if roles else []
    rules += [("REQUESTER_DELEGATION_FORBIDDEN", (giver != "") & (giver == asker))] if need.no_requester else []
    rules += [("DELEGATOR_SELF_REFERENCE", (giver != "") & (giver == actor))] if need.delegation else [("DELEGATION_NOT_ALLOWED", giver != "")]
    if need.need_reference:
        rules += [("DELEGATION_REFERENCE_REQUIRED", (giver != "") & (said("delegation_reference") == "")), ("DELEGATION_REFERENCE_WITHOUT_DELEGATOR", (giver == "") & (said("delegation_reference") != ""))]
    return j.withColumn("code", F.coalesce(*[F.when(broken, f"APPROVAL_{code}") for code, broken in rules])).drop(*[f"_{c}" for c in bound])


def validate_approvals(approvals: DataFrame, plans: DataFrame, now: Column, roles: tuple[str, ...]) -> DataFrame:
    """approvals with ``failure``, the first failing rule in order (null if none), and ``valid``.

    approvals: approval_id, plan_id, actor, role, requester, granted, fingerprint, issued_at, expires_at. plans: plan_id, plan_fingerprint.
    """
    j = approvals.join(plans.select("plan_id", "plan_fingerprint"), "plan_id", "left")
    failure = (F.when(~F.coalesce("granted", F.lit(False)), "NOT_GRANTED").when(F.col("plan_fingerprint").isNull(), "UNKNOWN_PLAN")
               .when(~F.col("fingerprint").eqNullSafe(F.col("plan_fingerprint")), "FINGERPRINT_MISMATCH").when(F.coalesce(F.col("expires_at") <= now, F.lit(True)), "EXPIRED")
               .when(F.coalesce(F.col("issued_at") > now, F.lit(True)), "ISSUED_IN_FUTURE").when(F.col("actor").eqNullSafe(F.col("requester")), "SELF_APPROVAL").when(~F.coalesce(F.col("role").isin(*roles), F.lit(False)), "ROLE_NOT_ALLOWED"))
    return j.withColumn("failure", failure).withColumn("valid", F.col("failure").isNull()).drop("plan_fingerprint")


def approval_set_status(approvals: DataFrame, required: tuple[str, ...], needed: int) -> DataFrame:
    """Status of each plan's valid approvals: duplicate ids, too few, too few actors, missing roles, or APPROVED."""
    need = F.array(*[F.lit(r) for r in required])
    per = approvals.where("valid").groupBy("plan_id").agg(F.count("*").alias("n"), F.countDistinct("approval_id").alias("ids"), F.countDistinct("actor").alias("actors"), F.array_sort(F.array_except(need, F.collect_set("role"))).alias("missing_roles"))
    status = (F.when(F.col("n") > F.col("ids"), "DUPLICATE_APPROVAL").when(F.col("n") < needed, "QUORUM_NOT_MET").when(F.col("actors") < needed, "ACTORS_NOT_DISTINCT").when(F.size("missing_roles") > 0, "ROLES_MISSING").otherwise("APPROVED"))
    return per.withColumn("status", status)


def consumed(approvals: DataFrame, ledger: DataFrame) -> DataFrame:
    """Approvals whose fingerprint an ended repair has used. ledger: status, approval_fingerprints."""
    used = ledger.where(F.col("status").isin("COMPLETED", "FAILED")).select(F.explode("approval_fingerprints").alias("fingerprint")).distinct()
    return approvals.join(used, "fingerprint", "left_semi")


def identity_status(approvals: DataFrame, identities: DataFrame, now: Column) -> DataFrame:
    """First reason why an approver's identity doesn't hold: unknown, inactive, revoked, expired, another role."""
    j = approvals.join(identities.select("actor", "active", "revoked", "valid_until", F.col("role").alias("_role")), "actor", "left")
    return j.withColumn("identity", F.when(F.col("active").isNull(), "UNKNOWN").when(~F.col("active"), "INACTIVE").when(F.col("revoked"), "REVOKED").when(F.col("valid_until") < now, "EXPIRED").when(F.col("role") != F.col("_role"), "ROLE_MISMATCH").otherwise("OK")).drop("active", "revoked", "valid_until", "_role")
