"""Reports over a table of work items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsignal.functions.scores import retry_delay_cap
from postsignal.policies import BacklogPolicy, RetryPolicy


def band(priority: Column) -> Column:
    return F.when(priority >= 100, 3).when(priority >= 50, 2).otherwise(1)


def aged_priority(priority: Column, created_us: Column, now_us: int, policy: BacklogPolicy = BacklogPolicy()) -> Column:
    """Priority plus one per full aging interval of waiting, boost capped."""
    interval = max(1, policy.aging_interval_s) * 1_000_000
    waited = F.greatest(F.lit(0).cast("long"), F.floor((F.lit(now_us) - created_us) / interval))
    return priority + F.least(F.lit(max(0, policy.max_boost)).cast("long"), waited)


def next_items(jobs: DataFrame, now_us: int, per_class: int = 50, policy: BacklogPolicy = BacklogPolicy()) -> DataFrame:
    """The next ``per_class`` eligible items of every resource class, in claiming order.

    ``jobs``: job_id, status, resource_class, priority, available_us, created_us. The rank limit is
    applied on the map side too, so a class holding most of the backlog sends only its leaders.
    """
    open_ = jobs.filter(F.col("status").isin("pending", "retry") & (F.col("available_us") <= now_us))
    ranked = open_.withColumn("effective_priority", aged_priority(F.col("priority"), F.col("created_us"), now_us, policy))
    order = Window.partitionBy("resource_class").orderBy(
        band(F.col("priority")).desc(), F.desc("effective_priority"), F.desc("priority"), "created_us", "job_id"
    )
    return ranked.withColumn("claim_rank", F.row_number().over(order)).filter(F.col("claim_rank") <= per_class)


def status_summary(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status", "resource_class").agg(F.count(F.lit(1)).alias("items"))


def class_load(jobs: DataFrame) -> DataFrame:
    """Queued and running items per resource class."""
    return jobs.groupBy("resource_class").agg(
        F.count_if(F.col("status").isin("pending", "retry")).alias("queued"),
        F.count_if(F.col("status") == "running").alias("running"),
    )


def board_summary(tasks: DataFrame, always: tuple[str, ...] = ("todo", "in_progress", "done")) -> DataFrame:
    """Items per status; the usual statuses appear even with none."""
    seeds = tasks.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in always])).alias("status"))
    counts = tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(seeds, "status", "full_outer").select(
        "status", F.coalesce("n", F.lit(0).cast("long")).alias("items")
    )


def failed_items(dead: DataFrame, jobs: DataFrame, limit: int = 50) -> DataFrame:
    """Latest failures with their item, newest first; at least one row is asked for."""
    joined = dead.join(jobs, "job_id")
    return joined.orderBy(F.desc("failed_at"), F.desc("job_id")).limit(max(1, limit))


def route_failures(failures: DataFrame, policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """Failed attempts to ``retry`` or ``dead``, with the error code and the longest delay.

    ``failures``: error_kind (fatal, timeout or anything else) and attempt.
    """
    fatal = F.col("error_kind") == "fatal"
    code = F.when(fatal, "FatalJobError").when(F.col("error_kind") == "timeout", "STAGE_TIMEOUT").otherwise(
        F.col("error_kind")
    )
    retry = ~fatal & (F.col("attempt") < policy.max_attempts)
    delay = retry_delay_cap(F.col("attempt"), policy.base_s, policy.factor, policy.max_delay_s)
    return failures.select(
        "*",
        code.alias("error_code"),
        F.when(retry, "retry").otherwise("dead").alias("outcome"),
        F.when(retry, delay).alias("delay_cap_s"),
    )
