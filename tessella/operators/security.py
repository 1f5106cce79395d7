"""Access rules as joins: ACL entries, roles with inheritance, permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import NotFoundError
from tessella.functions.expressions import attributes_match, operation_matches, path_matches
from tessella.scratch import stored


def _any(pattern: str, value: str) -> Column:
    """An absent, empty or * pattern admits everything."""
    return F.coalesce(F.col(pattern), F.lit("")).isin("", "*") | (F.col(pattern) == F.col(value))


def live(acl: DataFrame, now: Column) -> DataFrame:
    return acl.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def add_entries(acl: DataFrame, entries: DataFrame) -> DataFrame:
    """The union without repeated rules."""
    return acl.unionByName(entries).dropDuplicates([c for c in acl.columns if c != "expires_at"])


def remove_entries(acl: DataFrame, entries: DataFrame) -> DataFrame:
    return acl.join(entries, [c for c in entries.columns if c != "expires_at"], "left_anti")


#: Rules for any subject are sent to all tasks only if they are counted and no more.
BROADCAST_RULES = 100_000


def acl_check(requests: DataFrame, acl: DataFrame, now: Column) -> DataFrame:
    """requests: request_id, subject, resource, operation and, where rules ask for them, subject_type, subject_attributes,
    resource_type, resource_attributes (maps) -> request_id, allowed, denied. Deny wins, no rule denies.

    Rules that name the subject meet requests by an equi-join on it. Those for any subject are compared with every
    request if they are few; more of them meet it by the first part of their path, those without one by a constant.
    Patterns, types and attributes are then expressions on the joined rows."""
    rules = live(acl, now).withColumnRenamed("operation", "rule_operation")
    fits = path_matches(F.col("resource_id"), F.col("resource")) & operation_matches(F.col("rule_operation"), F.col("operation"))
    for side in ("subject", "resource"):
        kind, attributes = f"{side}_type", f"{side}_attributes"
        if kind in rules.columns and kind in requests.columns:
            rules = rules.withColumnRenamed(kind, "rule_" + kind)
            fits = fits & _any("rule_" + kind, kind)
        if attributes in rules.columns and attributes in requests.columns:
            rules = rules.withColumnRenamed(attributes, "rule_" + attributes)
            own = F.col("rule_" + attributes)
            fits = fits & (own.isNull() | attributes_match(own, F.col(attributes)))
    named = requests.join(rules.where("subject_id <> '*'"), (F.col("subject") == F.col("subject_id")) & fits)
    open_rules = rules.where("subject_id = '*'")
    if open_rules.count() <= BROADCAST_RULES:
        anyone = requests.join(F.broadcast(open_rules), fits)
    else:
        part = lambda c: F.regexp_extract(c, "^/?([^/*]+)", 1)
        pathed = F.col("resource_id").rlike("^/?[^/*]+/")
        anyone = requests.join(open_rules.where(pathed), (part(F.col("resource")) == part(F.col("resource_id"))) & fits)
        rest = open_rules.where(~pathed | F.col("resource_id").isNull())
        anyone = anyone.unionByName(requests.join(rest, fits))
    hits = named.unionByName(anyone).groupBy("request_id").agg(F.bool_or(F.col("effect") == "deny").alias("denied"), F.bool_or(F.col("effect") == "allow").alias("allow"))
    out = requests.select("request_id").join(hits, "request_id", "left")
    denied = F.coalesce("denied", F.lit(False))
    return out.select("request_id", (~denied & F.coalesce("allow", F.lit(False))).alias("allowed"), denied.alias("denied"))


def update_entries(acl: DataFrame, entries: DataFrame) -> DataFrame:
    """entries: subject_id, resource_id, operation and new values of other columns; rules of these three get them."""
    key = ["subject_id", "resource_id", "operation"]
    changed = [c for c in entries.columns if c not in key]
    new = entries.select(*key, *[F.col(c).alias("new_" + c) for c in changed], F.lit(True).alias("hit"))
    return acl.join(new, key, "left").select(*[F.when(F.col("hit"), F.col("new_" + c)).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in acl.columns])


def effective_roles(assigned: DataFrame, parents: DataFrame) -> DataFrame:
    """assigned: subject, role; parents: role, parent -> subject, role, all inherited ones too. The closure of the roles
    is squared until it doesn't grow, so chains of any length take log2 of it in rounds, and cycles end."""
    links = parents.select("role", F.col("parent").alias("up")).where("role is not null and up is not null").distinct()
    closure = stored(links, "closure")
    n = closure.count()
    while n:
        further = closure.join(closure.select(F.col("role").alias("up"), F.col("up").alias("top")), "up").select("role", F.col("top").alias("up"))
        closure = stored(closure.unionByName(further).distinct(), "closure")
        before, n = n, closure.count()
        if n == before:
            break
    own = assigned.select("subject", "role")
    return own.unionByName(own.join(closure, "role").select("subject", F.col("up").alias("role"))).distinct()


def assign(assigned: DataFrame, roles: DataFrame, new: DataFrame) -> DataFrame:
    """Assignments with the new ones (subject, role); a role that doesn't exist is an error."""
    unknown = new.join(roles.select("role"), "role", "left_anti").select("role").first()
    if unknown is not None:
        raise NotFoundError(f"role {unknown['role']}")
    return assigned.select("subject", "role").unionByName(new.select("subject", "role")).distinct()


def rbac_check(requests: DataFrame, roles: DataFrame, permissions: DataFrame) -> DataFrame:
    """roles: subject, role (effective); permissions: role, resource_pattern, operations -> request_id, allowed."""
    held = requests.join(roles, "subject").join(permissions, "role")
    open_pattern = F.coalesce(F.col("resource_pattern"), F.lit("")) == ""
    fits = (open_pattern | path_matches(F.col("resource_pattern"), F.col("resource"))) & (F.array_contains("operations", F.col("operation")) | F.array_contains("operations", F.lit("*")))
    hits = held.where(fits).select("request_id").distinct().withColumn("hit", F.lit(True))
    return requests.select("request_id").join(hits, "request_id", "left").select("request_id", F.coalesce("hit", F.lit(False)).alias("allowed"))


def access(requests: DataFrame, acl: DataFrame, roles: DataFrame, permissions: DataFrame, now: Column, deny_wins: bool = True) -> DataFrame:
    """Allowed by ACL or roles; an explicit deny stands unless deny_wins is False."""
    a = acl_check(requests, acl, now).withColumnRenamed("allowed", "acl_allowed")
    r = rbac_check(requests, roles, permissions).withColumnRenamed("allowed", "rbac_allowed")
    allowed = F.col("acl_allowed") | (F.col("rbac_allowed") & ~F.col("denied") if deny_wins else F.col("rbac_allowed"))
    return a.join(r, "request_id").select("request_id", allowed.alias("allowed"))
