"""Run bookkeeping as tables: status log, latest view, due work, alerts.

The reference updates one `runs` row in place; here status changes are an
append-only event log and the current state is a grouped ``max_by`` view, so
writers never rewrite history and concurrent runs never contend on a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revwise.functions.text import iso_week, to_ist

SUCCESS_STATUSES = ("summarized", "published")

# status → the stage that runs next
NEXT_STAGE = {"pending": "ingest", "ingested": "cluster", "clustered": "summarize",
              "summarized": "render", "rendered": "publish", "published": "done"}


def latest_status(events: DataFrame) -> DataFrame:
    """Current status by run = status of the newest (updated_at, seq) event."""
    key = F.struct("updated_at", "seq")
    return (events.groupBy("run_id")
            .agg(F.max_by("status", key).alias("status"),
                 F.max("updated_at").alias("updated_at"),
                 F.count(F.lit(1)).alias("n_events")))


def recent_runs(latest: DataFrame, n: int = 5, successful_only: bool = False) -> DataFrame:
    """Newest n runs (TakeOrderedAndProject, total order by run id on ties)."""
    if successful_only:
        latest = latest.filter(F.col("status").isin(*SUCCESS_STATUSES))
    return latest.orderBy(F.col("updated_at").desc(), F.col("run_id")).limit(n)


def _stage_of(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(list(NEXT_STAGE.items())):
        out = F.when(status == k, F.lit(v)).otherwise(out)
    return out


def next_stage(events: DataFrame) -> DataFrame:
    """Due work by run.  A failed run resumes after its last good status."""
    key = F.struct("updated_at", "seq")
    g = (events.groupBy("run_id")
         .agg(F.max_by("status", key).alias("status"),
              F.max_by(F.when(F.col("status") != "failed", F.col("status")),
                       F.when(F.col("status") != "failed", key)).alias("last_ok")))
    resume = F.when(F.col("status") == "failed", F.coalesce(_stage_of(F.col("last_ok")),
                                                            F.lit("ingest")))
    return g.select("run_id", "status", F.coalesce(resume, _stage_of(F.col("status")),
                                                   F.lit("ingest")).alias("next_stage"))


def insert_absent(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Existing rows plus the new rows whose key is absent (INSERT OR IGNORE)."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def weekly_stats(rows: DataFrame, group: str, ts: str, value: str) -> DataFrame:
    """Count and mean of ``value`` by (group, ISO week in India time)."""
    local = to_ist(F.col(ts))
    return (rows.groupBy(F.col(group).alias("product_key"),
                         iso_week(F.col(ts)).alias("iso_week"),
                         F.to_date(F.date_trunc("week", local)).alias("week_start"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")))


def wow_alerts(weekly: DataFrame, drop: float = 0.5, shift: float = 1.0) -> DataFrame:
    """Compare each week with the week before (only if exactly 7 days before).

    The window runs over the weekly aggregate (one row per product and week), so
    a product's partition is its number of weeks, never its number of reviews.
    """
    w = Window.partitionBy("product_key").orderBy("week_start")
    prev_start = F.lag("week_start").over(w)
    adjacent = F.date_add(prev_start, 7) == F.col("week_start")
    prior_n = F.when(adjacent, F.lag("n").over(w))
    prior_mean = F.when(adjacent, F.lag("mean").over(w))
    out = weekly.select("*", prior_n.alias("prior_n"), prior_mean.alias("prior_mean"))
    return out.select(
        "product_key", "iso_week", "n", "mean", "prior_n", "prior_mean",
        F.coalesce((F.col("prior_n") > 0) & (F.col("n") < F.col("prior_n") * drop), F.lit(False))
        .alias("volume_alert"),
        F.coalesce(F.abs(F.col("mean") - F.col("prior_mean")) > shift, F.lit(False))
        .alias("rating_alert"))


def error_rates(calls: DataFrame, group: str = "run_id", failed: str = "failed",
                response_limit: float = 0.02, delivery_limit: float = 0.01) -> DataFrame:
    """Failure share by group with the two documented thresholds."""
    g = calls.groupBy(group).agg(F.count(F.lit(1)).alias("n"),
                                 F.count_if(F.col(failed)).alias("failed"))
    share = F.col("failed") / F.col("n")
    return g.select(group, "n", "failed", share.alias("failure_share"),
                    (share > response_limit).alias("response_alert"),
                    (share > delivery_limit).alias("delivery_alert"))
