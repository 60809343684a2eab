"""Billing event log to subscription and invoice tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import latest_per_key

# Status names; everything else counts as CANCELLED.
STATUS = {"active": "ACTIVE", "trialing": "TRIALING", "canceled": "CANCELLED", "past_due": "PAST_DUE",
          "unpaid": "UNPAID", "incomplete": "INCOMPLETE"}

SUBSCRIPTION = ("id string, customer string, status string, price string, unit_amount long, currency string, "
                "plan_name string, search_limit int, scrape_limit int, rate_limit string, "
                "current_period_start long, current_period_end long, cancel_at_period_end boolean")
INVOICE = "id string, customer string, amount_due long, amount_paid long, paid_at long"


def status_of(c: Column) -> Column:
    out = F.lit("CANCELLED")
    for k, v in STATUS.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def plan_type(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return (F.when(F.contains(n, F.lit("scale")), "SCALE").when(F.contains(n, F.lit("growth")), "GROWTH")
            .when(F.contains(n, F.lit("pro")), "PRO").when(F.contains(n, F.lit("enterprise")), "ENTERPRISE")
            .otherwise("FREE"))


def subscriptions(log: DataFrame, users: DataFrame) -> DataFrame:
    """(event_id, seq, type, payload) -> current state of each subscription of a known user."""
    d = (log.where(F.col("type").startswith("customer.subscription."))
         .dropDuplicates(["event_id"])
         .select("seq", "type", F.from_json("payload", SUBSCRIPTION).alias("p"))
         .select("seq", "type", "p.*"))
    last = latest_per_key(d, ["id"], [F.col("seq")])
    cancelled = (F.col("type") == "customer.subscription.deleted") | F.coalesce(
        F.col("cancel_at_period_end"), F.lit(False))
    return last.join(users, "customer").select(
        "id", "user_id", plan_type(F.col("plan_name")).alias("plan_type"),
        F.when(cancelled, "CANCELLED").otherwise(status_of(F.col("status"))).alias("status"),
        (F.col("unit_amount") / 100).alias("amount"),
        F.coalesce("search_limit", F.lit(5000)).alias("search_limit"),
        F.coalesce("scrape_limit", F.lit(500)).alias("scrape_limit"),
        F.coalesce("rate_limit", F.lit("10/minute")).alias("rate_limit"),
        F.timestamp_seconds("current_period_start").alias("period_start"))


def invoices(log: DataFrame, users: DataFrame) -> DataFrame:
    d = (log.where("type = 'invoice.paid'").dropDuplicates(["event_id"])
         .select("seq", F.from_json("payload", INVOICE).alias("p")).select("seq", "p.*"))
    return latest_per_key(d, ["id"], [F.col("seq")]).join(users, "customer").select(
        "id", "user_id", F.lit("paid").alias("status"), "amount_due", "amount_paid",
        F.timestamp_seconds("paid_at").alias("paid_at"))
