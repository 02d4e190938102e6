"""Entitlements, seats, access codes and record-level rules as set operations over all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK = {"free": 0, "pro": 1, "team": 2}
GRACE_DAYS = 3


def rank(plan: Column) -> Column:
    return F.when(plan == "team", 2).when(plan == "pro", 1).otherwise(0)


def plan_of(rank_col: Column) -> Column:
    return F.when(rank_col == 2, "team").when(rank_col == 1, "pro").otherwise("free")


def subscription_active(plan: Column, status: Column, end: Column, now: Column) -> Column:
    """Running ones have three days of grace after their end, ended ones none; ends are exclusive."""
    grace = end + F.expr(f"INTERVAL {GRACE_DAYS} DAYS")
    live = F.when(status.isin("active", "attention"), grace > now).when(status.isin("non-renewing", "cancelled", "complete"), end > now)
    return F.coalesce(plan.isin("pro", "team") & live, F.lit(False))


def own_plans(profiles: DataFrame, now: Column) -> DataFrame:
    """profiles (id, subscription_plan, subscription_status, current_period_end, prepaid_plan, paid_until, team_until, pro_until)
    with plan and source; at equal rank a subscription, then a prepaid term, then tester access is named."""
    sub = F.when(subscription_active(F.col("subscription_plan"), F.col("subscription_status"), F.col("current_period_end"), now), rank(F.col("subscription_plan"))).otherwise(0)
    pre = F.when(F.coalesce(F.col("paid_until") > now, F.lit(False)), rank(F.col("prepaid_plan"))).otherwise(0)
    test = F.when(F.coalesce(F.col("team_until") > now, F.lit(False)), 2).when(F.coalesce(F.col("pro_until") > now, F.lit(False)), 1).otherwise(0)
    ranked = profiles.select("*", sub.alias("_s"), pre.alias("_p"), test.alias("_t")).withColumn("_r", F.greatest("_s", "_p", "_t"))
    source = F.when(F.col("_r") == 0, F.lit(None)).when(F.col("_s") == F.col("_r"), "subscription").when(F.col("_p") == F.col("_r"), "prepaid").otherwise("tester")
    return ranked.withColumn("plan", plan_of(F.col("_r"))).withColumn("source", source).drop("_s", "_p", "_t", "_r")


def effective_plans(users: DataFrame, plans: DataFrame, seats: DataFrame) -> DataFrame:
    """users (id, email, email_confirmed_at), plans (id, plan), seats (owner_id, email): a confirmed user whom another user on
    the team plan lists has the team plan, others their own."""
    owners = seats.join(plans.filter("plan = 'team'").select(F.col("id").alias("owner_id")), "owner_id", "left_semi")
    seated = users.filter("email_confirmed_at IS NOT NULL").alias("u").join(owners.alias("o"), F.expr("lower(u.email) = o.email AND u.id <> o.owner_id"), "left_semi")
    seat = seated.select("id", F.lit(True).alias("seat"))
    return users.select("id").join(plans.select("id", "plan"), "id", "left").join(seat, "id", "left").select("id", F.when(F.col("seat"), "team").otherwise(F.coalesce("plan", F.lit("free"))).alias("plan"))


def code_status(codes: DataFrame, now: Column) -> DataFrame:
    """First that holds: revoked, expired, used up, active."""
    status = F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") <= now, "expired").when(F.col("uses") >= F.col("max_uses"), "used up").otherwise("active")
    return codes.withColumn("status", status).withColumn("remaining", F.greatest(F.lit(0), F.col("max_uses") - F.col("uses")))


def guarded_write(old: DataFrame, new: DataFrame, key: str, protected: list[str], trusted: Column) -> DataFrame:
    """The new rows, but untrusted writers leave the protected columns as they were."""
    both = new.alias("n").join(old.alias("o"), F.col(f"n.{key}") == F.col(f"o.{key}"), "left")
    keep = lambda c: F.when(trusted | F.col(f"o.{key}").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(*(keep(c) if c in protected else F.col(f"n.{c}") for c in new.columns))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, with the names of all they break; a check that is null holds."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items())))
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def merged(first: DataFrame, extra: DataFrame, key: list[str], fill: list[str]) -> DataFrame:
    """All of first, nulls in `fill` taken from the extra row with the same key; then the rest of extra. Keys are unique."""
    both = first.alias("a").join(extra.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "left")
    kept = both.select(*(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) if c in fill else F.col(f"a.{c}") for c in first.columns))
    rest = extra.alias("b").join(first.alias("a"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "left_anti")
    return kept.withColumn("origin", F.lit("first")).unionByName(rest.withColumn("origin", F.lit("extra")), allowMissingColumns=True)
