"""Billing as folds over a log: one user's events in order, users in parallel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "subscription_plan string, subscription_status string, current_period_end timestamp, subscription_code string, prepaid_plan string, paid_until timestamp"


def add_months(at: Column, months: Column) -> Column:
    """Keeps the time of day and clamps the day."""
    return at + F.make_ym_interval(F.lit(0), months)


def carried_over(left_seconds: Column, old_price: Column, new_price: Column) -> Column:
    """Seconds that time left on one plan is worth on another."""
    return F.floor(left_seconds * old_price / new_price)


def settled(log: DataFrame) -> DataFrame:
    """log (user_id, key, type, event_ts, plan, code, period_end, months) to each user's state after all events.

    An event key counts once. create starts a subscription; charge moves its end; not_renew and disable end it at the paid time;
    prepay adds months after what is already paid. not_renew, disable and charge that come before their create are kept and
    applied right after it; a create that is sent again changes nothing."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["event_ts", "key"], kind="stable")
        state = {c.split()[0]: None for c in STATE.split(", ")}
        known, waiting = set(), []

        def apply(e) -> None:
            if e.type == "create":
                if e.code in known:
                    return
                known.add(e.code)
                state.update(subscription_plan=e.plan, subscription_status="active", current_period_end=e.period_end, subscription_code=e.code)
                again = [w for w in waiting if w.code == e.code]
                waiting[:] = [w for w in waiting if w.code != e.code]
                for w in again:
                    apply(w)
            elif e.type == "prepay":
                start = max(e.event_ts, state["paid_until"]) if state["paid_until"] is not None else e.event_ts
                state.update(prepaid_plan=e.plan, paid_until=start + pd.DateOffset(months=int(e.months)))
            elif e.code not in known:
                waiting.append(e)
            elif e.code == state["subscription_code"]:
                if e.type == "charge":
                    state.update(subscription_status="active", current_period_end=e.period_end)
                elif e.type == "failed":
                    state.update(subscription_status="attention")
                else:
                    state.update(subscription_status={"not_renew": "non-renewing", "disable": "cancelled"}[e.type])

        for e in rows.itertuples(index=False):
            apply(e)
        return pd.DataFrame([{"user_id": key[0]} | state])

    once = log.dropDuplicates(["key"])
    kind = dict(log.dtypes)["user_id"]
    return once.groupBy("user_id").applyInPandas(fold, f"user_id {kind}, {STATE}")


def redeemed(grants: DataFrame, now: Column) -> DataFrame:
    """grants (user_id, redeemed_at, plan 'team' or 'pro', days) stacked in order: each starts when it is redeemed or when
    what runs for its plan ends, whichever is later. user_id, team_until, pro_until."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        until: dict[str, pd.Timestamp | None] = {"team": None, "pro": None}
        for g in rows.sort_values(["redeemed_at", "plan", "days"]).itertuples(index=False):
            start = g.redeemed_at
            for plan in ("team",) if g.plan == "team" else ("team", "pro"):  # pro time runs after team time
                start = max(start, until[plan]) if until[plan] is not None else start
            until[g.plan] = start + pd.Timedelta(days=int(g.days))
        return pd.DataFrame([{"user_id": key[0], "team_until": until["team"], "pro_until": until["pro"]}])

    kind = dict(grants.dtypes)["user_id"]
    return grants.filter(F.col("redeemed_at") <= now).groupBy("user_id").applyInPandas(fold, f"user_id {kind}, team_until timestamp, pro_until timestamp")


def seat_error(owner_plan: Column, owner_email: Column, members: Column, email: Column, most: int) -> Column:
    """Why an address can't have a seat, the first reason that holds; null if it can."""
    return (
        F.when(owner_plan != "team", "not-team").when(email.isNull(), "invalid").when(email == F.lower(owner_email), "self").when(F.array_contains(members, email), "duplicate").when(F.size(members) >= most, "full")
    )
